"""Spark-native analytics for weighted graphs with many independent event sets."""
