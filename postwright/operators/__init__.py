"""Operators: functions from DataFrames to DataFrames. Nothing here collects an input."""
