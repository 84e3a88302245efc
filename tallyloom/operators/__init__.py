"""Operators on DataFrames: aggregations, joins, windows, sampling, estimators, batches."""
