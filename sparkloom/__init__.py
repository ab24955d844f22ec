"""Spark-first text retrieval, corpus preparation and operational analytics."""
