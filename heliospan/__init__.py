"""Spark-native analytics over station weather observations."""
