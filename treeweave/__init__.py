"""Acyclic multi-way joins and data preparation on Spark DataFrames."""
