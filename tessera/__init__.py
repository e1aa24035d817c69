"""Spark-native analytics over volumes, records, points and text."""
