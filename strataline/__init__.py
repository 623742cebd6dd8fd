"""Spark-native document analytics: chunking, retrieval, diffs, monitoring, verification, evaluation."""

__version__ = "0.1.0"
