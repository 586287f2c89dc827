"""Fathomline: survey analytics on PySpark DataFrames, Spark SQL and Structured Streaming."""
