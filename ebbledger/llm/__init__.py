"""Operators for preparing text corpora, each a plain function from DataFrames to DataFrames."""
