"""Operators of training-data pipelines: packing, deduplication, decontamination, filters and scores."""
