"""Spark-native engine for factor research and market-data processing."""
