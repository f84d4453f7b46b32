"""Operators of the catalog: each takes DataFrames and gives a DataFrame; none collects."""
