"""Spark-native dividend and equity analytics over long-format market tables."""

__version__ = "0.1.0"
