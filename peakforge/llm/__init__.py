"""Operators for training-data pipelines: extraction, filters, duplicates, contamination, tokens."""
