"""Persisted multi-table databases and their methods."""
