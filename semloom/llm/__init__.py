"""Operators for large training corpora, each a set of Spark jobs."""
