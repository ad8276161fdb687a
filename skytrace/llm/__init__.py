"""Operators of a training-data pipeline: scoring, deduplication, search, mixing and tokenisation.

Nothing outside this subpackage imports it, and it imports nothing from the rest of the library.
"""
