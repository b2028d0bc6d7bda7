"""Spark-native approximate sequence mapping and corpus preparation."""
