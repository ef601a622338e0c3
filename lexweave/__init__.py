"""Bitext and lexical-vector analytics on Spark DataFrames."""
