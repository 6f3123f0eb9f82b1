"""Spark-native analytics for ordered market-event data."""
