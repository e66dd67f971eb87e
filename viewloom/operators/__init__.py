"""Operators on graphs, view collections and results."""
