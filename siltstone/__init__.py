"""Spark-native search, retrieval and evaluation over document and source-code collections."""
