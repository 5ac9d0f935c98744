"""Timestamped media data as DataFrames."""
