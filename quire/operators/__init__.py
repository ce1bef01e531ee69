"""Operators over logical tables: DataFrames in, a DataFrame out."""
