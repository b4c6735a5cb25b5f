"""Operators of a training-data pipeline: filters, deduplication, mixing, extraction, search and tokens."""
