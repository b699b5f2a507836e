"""Operators: functions from DataFrame to DataFrame, made for ``df.transform(op, ...)``."""
