"""Millrace: a Spark-native engine for retrieval, knowledge-graph, memory and corpus analytics."""

__version__ = "0.1.0"
