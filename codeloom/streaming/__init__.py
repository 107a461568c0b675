"""Structured Streaming: incremental forms of batch operators."""
