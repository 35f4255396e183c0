"""Spark-native ingest, hybrid retrieval and evaluation over document corpora."""
