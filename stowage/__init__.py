"""Spark-native analytics for content-addressed storage."""
