"""Temporal fact graphs and training-corpus preparation as Spark jobs."""
