"""Operators on DataFrames, independent of any table's names."""
