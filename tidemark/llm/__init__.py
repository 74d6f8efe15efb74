"""Operators of a training-data pipeline: deduplication, filters, classifiers, sharding, tokenisation."""
