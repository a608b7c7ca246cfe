"""Operators for training-data pipelines: tokens, filters, near duplicates, sharding, packing."""
