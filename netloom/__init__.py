"""Spark-native analytics on network flow records."""
