"""Tidemark: timeline, interval and record-library analytics on Spark DataFrames."""
