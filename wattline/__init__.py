"""Spark-native analytics for meter and sensor readings."""

__version__ = "0.1.0"
