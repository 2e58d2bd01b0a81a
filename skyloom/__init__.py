"""Skyloom: a PySpark-native engine for linking moving-object detections, plus training-data operators."""

__version__ = "0.1.0"
