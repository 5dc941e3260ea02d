"""Spark-native discovery, routing, clustering and evaluation of events in long time series."""

__version__ = "0.1.0"
