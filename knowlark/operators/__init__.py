"""Spark-native operators."""
