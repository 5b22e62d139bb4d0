"""The update stream as Structured Streaming: windowed counts and the incremental topology."""
