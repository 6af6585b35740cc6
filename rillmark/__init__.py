"""Rillmark: partitioned event-log analytics on Spark DataFrames."""
