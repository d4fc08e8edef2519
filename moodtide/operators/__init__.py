"""Operators: each takes DataFrames and returns a DataFrame, for batch and stream alike where it can."""
