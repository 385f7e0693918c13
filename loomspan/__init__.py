"""Spark-first analytics engine: array operators, graph and symbol analytics, retrieval, diffs and attribution."""
