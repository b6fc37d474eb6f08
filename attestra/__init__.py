"""Spark-native conclusion-preservation engine."""

__version__ = "0.1.0"
