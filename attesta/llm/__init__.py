"""Operators for preparing training data: search, deduplication, mixing,
token accounting, packing, sharding, toxicity, media, language and similarity.

Nothing else in the library imports this subpackage.
"""
