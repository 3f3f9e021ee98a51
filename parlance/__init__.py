"""Spark-native analytics over logs of human-AI conversations."""

__version__ = "0.1.0"
