"""Spark-native analytics for assessment findings and training-data pipelines."""
