"""Operators of a training-data pipeline: packing, chat formatting, deduplication, filters and mixing."""
