"""Readers and parsers that make typed DataFrames of raw inputs, and writers."""
