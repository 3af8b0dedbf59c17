"""Spark-native code-intelligence, graph and corpus analytics."""
