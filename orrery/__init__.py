"""Governed analytics over star schemas and event tables, on Spark DataFrames."""
