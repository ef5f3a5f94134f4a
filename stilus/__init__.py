"""Stilus: a Spark-first engine for stylometry and text-corpus analytics."""

__version__ = "0.1.0"
