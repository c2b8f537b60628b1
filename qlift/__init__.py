"""Spark-native query-enhancement analytics."""

__version__ = "0.1.0"
