"""Spark-native map-tile analytics and training-data preparation."""
