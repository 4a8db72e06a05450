"""Operators of a training-data pipeline: deduplication, filtering, decontamination, mixing, sharding, token counts."""
