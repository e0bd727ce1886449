"""Regression analytics for wide numeric tables, expressed as Spark jobs."""

__version__ = "0.1.0"
