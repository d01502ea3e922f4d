"""Operators for preparing training data: mixing, deduplication, extraction, search, classification."""
