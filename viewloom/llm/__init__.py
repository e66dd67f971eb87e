"""Operators for preparing text corpora: extraction, deduplication, scans, counting, packing, search and formatting.

Each module holds one operator with its own general interface; ``registry`` applies them to the tables of a
data folder. Nothing else in the library imports this subpackage.
"""
