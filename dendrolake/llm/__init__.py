"""Operators for training-data pipelines. Nothing outside this package imports it."""
