"""Siltworks: tabular data quality, preparation and supervised learning as Spark jobs."""

__version__ = "0.1.0"
