"""Spark-native scoring, ranking and preparation of documents."""
