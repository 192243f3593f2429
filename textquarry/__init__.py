"""Spark-native text retrieval, evaluation and training-data analytics."""
