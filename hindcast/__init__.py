"""Hindcast: as-of analytics over code-review history, written as Spark jobs."""

__version__ = "0.1.0"
