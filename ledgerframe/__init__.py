"""Spark-first portfolio analytics over long DataFrames."""
