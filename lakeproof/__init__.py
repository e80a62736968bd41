"""Spark-native audit analytics over model artifacts and text corpora."""

__version__ = "0.1.0"
