"""Operators for preparing text corpora, and their queries over the given tables."""
