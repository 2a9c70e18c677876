"""Operators for preparing training data: formatting, deduplication, tokenisation, scoring and filters."""
