"""Operators of a training-data pipeline: scoring, packing, search, language, tokens, deduplication."""
