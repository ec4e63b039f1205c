"""Spark-native analysis of source-repository estates."""
