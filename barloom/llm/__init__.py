"""Operators for training corpora: scoring, deduplication, tokenising, filtering, mixing."""
