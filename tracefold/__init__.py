"""Diagnostic-log and source-text analytics on Spark DataFrames."""
