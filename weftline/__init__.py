"""Spark-native text clustering and analytics engine."""

__version__ = "0.1.0"
