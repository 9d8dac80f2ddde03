"""Operators on DataFrames; keys, order and value columns are parameters."""
