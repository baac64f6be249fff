"""Spark-native document analytics and question answering."""
