"""Operators on DataFrames keyed by ``series_id``."""
