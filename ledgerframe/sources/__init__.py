"""Spark-first portfolio analytics: sources."""
