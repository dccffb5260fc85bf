"""Operators over table rows, each a function from DataFrames to DataFrames."""
