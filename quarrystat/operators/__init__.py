"""Operators: each takes DataFrames and returns DataFrames or small vectors."""
