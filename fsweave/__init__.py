"""Finite-state string transformations and sequence models on Spark DataFrames."""
