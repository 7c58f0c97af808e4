"""Spark-native engine for code-intelligence queries over text and source corpora."""
