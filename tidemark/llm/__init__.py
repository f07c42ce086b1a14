"""Operators for preparing training text: compression, deduplication, privacy, quality, sharding and mixing."""
