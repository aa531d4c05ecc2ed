"""Queries by name, with the same results in ANSI SQL."""
