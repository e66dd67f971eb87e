"""Expressions compiled to Spark columns."""
