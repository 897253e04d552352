"""Operators of a training-data pipeline: filters, near copies, sharding, tokens and extraction."""
