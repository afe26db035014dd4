"""Operators: functions from DataFrames to DataFrames, over any column names."""
