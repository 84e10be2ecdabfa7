"""Spark-native analytics over panels: many entities observed over many dates."""
