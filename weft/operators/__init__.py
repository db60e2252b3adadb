"""Relational operators: functions from DataFrames to DataFrames, lazy, with rules and thresholds as parameters."""
