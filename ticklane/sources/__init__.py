"""Readers of raw files and views of the harness tables in this domain."""
