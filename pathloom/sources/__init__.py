"""Readers and writers: update logs, relationship and membership files, snapshots, keyed upserts."""
