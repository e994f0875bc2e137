"""Crestline: moment analytics over event streams, expressed as Spark DataFrame plans."""

__version__ = "0.1.0"
