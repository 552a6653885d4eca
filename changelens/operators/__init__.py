"""Joins, aggregations, windows and folds over changes."""
