"""Spark-first portfolio analytics: plans."""
