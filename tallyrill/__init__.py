"""Spark-native verified telemetry analytics."""
