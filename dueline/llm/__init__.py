"""Operators for training-data corpora: cleaning, deduplication, mixing, tokens, packing, search.

Nothing else in the library imports this package.
"""
