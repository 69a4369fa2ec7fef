"""Operators for training-data pipelines: deduplication, search, packing, extraction and scoring."""
