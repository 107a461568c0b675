"""Operators for preparing language-model training corpora.

Nothing outside this subpackage imports it. Every operator takes and returns
DataFrames; Python code runs in Arrow batches on the executors, and whatever
reaches the driver or is broadcast has a bound stated where it is collected.
"""
