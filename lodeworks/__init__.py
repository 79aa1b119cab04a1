"""Spark-native code intelligence, retrieval and evaluation engine."""

__version__ = "0.1.0"
