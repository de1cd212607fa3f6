"""Waymark: anchored code-knowledge records as Spark DataFrames."""
