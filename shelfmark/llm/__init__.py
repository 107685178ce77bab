"""Operators for preparing training data: deduplication, filtering, search and tokenising."""
