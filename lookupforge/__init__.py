"""Sparse feature lookup and update on Spark DataFrames."""
