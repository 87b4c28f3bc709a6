"""Joins, aggregations and group-wise operators."""
