"""Relational operators over typed tables and plain DataFrames."""
