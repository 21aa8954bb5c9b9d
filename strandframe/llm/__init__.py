"""Operators for preparing training data (deduplication, tokens, quality, mixing, sharding)."""
