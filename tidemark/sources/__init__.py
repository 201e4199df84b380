"""Typed reading of CSV and JSON."""
