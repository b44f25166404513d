"""Spark-native analytics over stored spreadsheet financial models."""

__version__ = "0.1.0"
