"""Operators over cube and catalog DataFrames."""
