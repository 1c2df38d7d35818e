"""Operators of a training-data pipeline: extraction, scoring, deduplication, packing, search.

Nothing outside this subpackage imports it.
"""
