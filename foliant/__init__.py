"""Spark-native document analytics: DataFrames in, DataFrames out."""

__version__ = "0.1.0"
