"""Operators: DataFrames in, DataFrames of measures or violations out."""
