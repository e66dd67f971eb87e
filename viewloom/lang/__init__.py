"""The query language."""
