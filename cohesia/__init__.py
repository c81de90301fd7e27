"""Cohesive-subgraph analytics on Spark: every operator is a DataFrame plan."""

__version__ = "0.1.0"
