"""Operators on DataFrames, usable without the dialect."""
