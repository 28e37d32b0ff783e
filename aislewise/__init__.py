"""Retail analytics and large-table data processing on Spark DataFrames."""
