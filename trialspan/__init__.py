"""Physiological time-series analytics on Spark DataFrames."""
