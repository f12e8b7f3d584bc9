"""Operators: functions from DataFrame to DataFrame, one module per family."""
