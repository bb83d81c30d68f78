"""Lecture-to-knowledge-graph analytics on Spark DataFrames."""
