"""Spark-native analytics over observed evidence: relational queries, temporal facts, text, web and streams."""
