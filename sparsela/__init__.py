"""Sparse representation analytics on Spark DataFrames."""
