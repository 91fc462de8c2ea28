"""Numerical analytics on Spark: arrays as DataFrames, and operations planned by Catalyst."""
