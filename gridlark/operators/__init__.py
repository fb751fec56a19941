"""Operators over tables: each takes DataFrames and gives DataFrames."""
