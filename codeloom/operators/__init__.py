"""Operators: pure functions from DataFrames to DataFrames."""
