"""Operators of a training-data pipeline: tokens, packing, deduplication, scoring, search."""
