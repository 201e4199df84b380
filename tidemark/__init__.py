"""Spark jobs for time-stamped operational data."""
