"""Whole-run pipelines and the log-shaped views of the sample tables."""
