"""Causal inference and information-flow statistics as Spark jobs."""
