"""Spark-native analytics over weighted exposure graphs."""

__version__ = "0.1.0"
