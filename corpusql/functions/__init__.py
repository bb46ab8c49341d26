"""Column expressions and per-row functions."""
