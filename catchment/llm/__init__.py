"""Operators for training-data pipelines: search, sharding, dedup, joins, archives, classifiers, mixing, language models."""
