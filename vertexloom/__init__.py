"""Batch graph analytics on PySpark DataFrames."""
