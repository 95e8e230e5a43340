"""Operators that prepare training data: mixing, filtering, near-duplicates, extraction and formatting."""
