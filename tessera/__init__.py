"""Spark-native record linkage."""
