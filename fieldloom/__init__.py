"""Spark-native analytics over signed-distance point samples keyed by scene."""
