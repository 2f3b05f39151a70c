"""Spark-native knowledge, retrieval and event-journal engine."""
