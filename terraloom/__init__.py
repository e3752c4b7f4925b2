"""Terraloom: spatial analytics and data preparation expressed as Spark jobs."""

__version__ = "0.1.0"
