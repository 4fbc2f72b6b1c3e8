"""Operators for preparing training text: dedup, filters, tokenization, packing and sharding."""
