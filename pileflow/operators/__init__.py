"""Interval, read, depth and statistics operators on DataFrames."""
