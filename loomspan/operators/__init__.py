"""Operators over DataFrames and columns."""
