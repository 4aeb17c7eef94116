"""Operators for preparing training text: scoring, cleaning, deduplication, mixing and packing.

Nothing outside this package imports it. `queries.py` registers one query per operator.
"""
