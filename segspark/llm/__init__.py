"""Operators for large training-data pipelines. Nothing else in segspark imports this package."""
