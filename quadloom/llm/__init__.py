"""Operators of a training-data pipeline: ten dealt operators and their shared helpers."""
