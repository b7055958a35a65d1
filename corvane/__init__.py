"""Corvane: a PySpark-native analytics engine for syndicated text streams."""
