"""Spark-native analytics over longitudinal per-subject signals."""
