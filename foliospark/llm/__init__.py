"""Operators for training-data pipelines: scoring, mixing, filtering, deduplication and packing."""
