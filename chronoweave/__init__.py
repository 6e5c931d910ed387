"""Temporal knowledge-graph analytics as Spark jobs."""
