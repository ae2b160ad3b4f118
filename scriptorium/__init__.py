"""Scriptorium: a Spark-first engine for building, matching and scoring text records."""

__version__ = "0.1.0"
