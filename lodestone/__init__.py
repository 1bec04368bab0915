"""Lodestone: a Spark-native knowledge and analytics engine."""
