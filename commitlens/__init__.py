"""Commit-history analytics on Spark DataFrames."""
