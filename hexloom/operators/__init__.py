"""Distributed operators: each takes and returns DataFrames."""
