"""Spark-native engine for judging the quality of short catalogue texts."""
