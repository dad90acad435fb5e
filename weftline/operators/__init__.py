"""Operators from DataFrames to a DataFrame, by family."""
