"""Spark-native analytics for the emotional content of long-form text."""
