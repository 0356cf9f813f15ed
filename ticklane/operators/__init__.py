"""Helpers that return plain DataFrames: grids, as-of and interval joins, runs, drawdowns, buckets."""
