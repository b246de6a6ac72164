"""Relational building blocks: each takes DataFrames or Columns and returns the same."""
