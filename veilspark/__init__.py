"""Spark-native text de-identification and training-data operators."""
