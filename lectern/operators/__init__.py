"""Operators: each takes and returns DataFrames, and works on many queries, documents or answers at once."""
