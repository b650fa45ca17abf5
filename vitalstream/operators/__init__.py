"""Relational operators: intervals, rhythm, windows, joins, metrics."""
