"""Operators that prepare training text: counting and packing tokens, filters, quality, duplicates, contamination, secrets.

Each module holds one operator; `queries` registers them over the test tables.
"""
