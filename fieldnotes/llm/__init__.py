"""Operators for building training data: extraction, filtering, deduplication, scans, scoring and tokens."""
