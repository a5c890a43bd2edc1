"""Spark-native analytics for large collections of prose."""

__version__ = "0.1.0"
