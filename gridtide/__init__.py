"""Gridded time series on Spark: cubes as long tables, operators as DataFrame functions."""
