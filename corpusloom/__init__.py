"""Spark-native corpus ingest, retrieval and corpus-maintenance operators."""

__version__ = "0.1.0"
