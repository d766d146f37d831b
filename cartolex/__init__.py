"""Spark-first engine for place data: text keys, spatial joins, geocoding, identity resolution and work planning."""

__version__ = "0.1.0"
