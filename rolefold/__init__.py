"""Listing matching and application tracking as Spark DataFrame jobs."""

__version__ = "0.1.0"
