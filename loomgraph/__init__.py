"""Spark-native engine for building and querying knowledge graphs over text."""

__version__ = "0.1.0"
