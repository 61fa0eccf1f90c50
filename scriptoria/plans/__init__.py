"""Registered queries, the inputs they derive from the given tables, and their SQL."""
