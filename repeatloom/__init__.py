"""Spark-native analytics for tandem and satellite repeats."""

__version__ = "0.1.0"
