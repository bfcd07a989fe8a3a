"""Spark-native operational-data analytics engine."""
