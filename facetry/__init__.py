"""Attribute representations of text items, computed as Spark jobs."""

__version__ = "0.1.0"
