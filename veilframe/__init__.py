"""Spark-native text de-identification and privacy analytics."""
