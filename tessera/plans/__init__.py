"""Composed plans: the pipeline builder and SQL."""
