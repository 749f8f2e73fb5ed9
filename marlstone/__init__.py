"""Columnar analytics on PySpark: a small catalog of typed tables, strict CSV loading, ordered
scans, metrics and profiles as DataFrame expressions, and an asynchronous query service."""

__version__ = "0.1.0"
