"""Quern: retrieval, evaluation and measurement operators on Spark DataFrames."""
