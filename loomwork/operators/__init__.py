"""Operators: functions of DataFrames that return DataFrames, with nothing bound to a table."""
