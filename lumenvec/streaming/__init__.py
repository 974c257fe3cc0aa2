"""Searching a static index with a stream of queries (an extension)."""
