"""Relational, windowed, graph and statistical operators. Each takes and returns DataFrames."""
