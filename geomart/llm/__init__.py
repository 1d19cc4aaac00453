"""Operators for training-data pipelines: sharding, deduplication, PII, counts, media, archives, tokens, toxicity, packing, resampling, repeated runs, URL filters.

Nothing else in the library imports this package.
"""
