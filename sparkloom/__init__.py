"""Spark-native analytics: corpus ETL, search, retrieval evaluation, score statistics."""
