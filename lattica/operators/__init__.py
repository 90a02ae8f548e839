"""Operators of graph retrieval over DataFrames."""
