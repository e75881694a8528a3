"""Operators: functions from DataFrames to DataFrames, over all queries at once."""
