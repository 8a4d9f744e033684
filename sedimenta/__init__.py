"""Corpus index, search and data-processing engine on Spark DataFrames."""
