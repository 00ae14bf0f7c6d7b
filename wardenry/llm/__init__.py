"""Corpus preparation for training data: deduplication, classification, mixing, sharding, packing."""
