"""Spark-native code-graph, retrieval and corpus analytics."""
