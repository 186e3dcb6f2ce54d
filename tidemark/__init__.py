"""Spark-native analytics for futures, options and trader-positioning tables."""
