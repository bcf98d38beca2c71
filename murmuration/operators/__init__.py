"""Operators on the domain tables: DataFrames in, a DataFrame out."""
