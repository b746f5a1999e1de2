"""Spark-native text clustering: ingest, embed, cluster, describe and report."""

__version__ = "0.1.0"
