"""Spark-native analytics over recordings of manual tasks."""
