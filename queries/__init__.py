"""Registered queries, the corpora they derive from the given tables, and their SQL."""
