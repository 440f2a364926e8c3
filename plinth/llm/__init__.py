"""Operators for training-data corpora: archives, filters, tokens, duplicates, contamination, quality."""
