"""Spark-native analytics for interaction networks, post streams and cascades."""
