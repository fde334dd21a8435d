"""Spark-first portfolio analytics: operators."""
