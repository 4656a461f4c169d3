"""Semantic schema analytics on PySpark."""
