"""Spark-native page, series and library analytics."""
