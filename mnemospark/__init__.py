"""Spark-native memory retrieval and analytics."""

__version__ = "0.1.0"
