"""Spark-native evaluation engine for labelled titles and prediction logs."""

__version__ = "0.1.0"
