"""Operators for large training-data pipelines: tokens, duplicates, quality, personal data."""
