"""Queries over the driver tables, each with its equivalent SQL."""
