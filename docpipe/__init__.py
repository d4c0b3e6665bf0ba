"""Spark-native processing of web responses: classify, convert, split, store, expire."""
