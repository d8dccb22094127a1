"""Operators for large-scale text and training-data pipelines."""
