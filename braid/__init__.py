"""Directed multiway relations on Spark DataFrames."""
