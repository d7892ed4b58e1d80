"""Narrative analytics on Spark DataFrames."""
