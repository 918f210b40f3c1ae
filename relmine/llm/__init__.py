"""Operators for preparing large text corpora (encoding, fingerprints,
packing, deduplication, personal data, toxicity, sharding, chat formatting).

Nothing else in the library imports this package.
"""
