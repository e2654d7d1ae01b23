"""Advertising analytics on Spark DataFrames."""
