"""Trace mining and trace-data preparation, written for Spark DataFrames."""

__version__ = "0.1.0"
