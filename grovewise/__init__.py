"""Queries over forests of hierarchical data, expressed as Spark DataFrames."""
