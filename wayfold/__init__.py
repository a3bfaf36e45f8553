"""Spark-native geocoding, place search and bulk cleaning of map data."""

__version__ = "0.1.0"
