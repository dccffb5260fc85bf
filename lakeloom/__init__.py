"""Semantic page analytics on Spark: operators over tables of captured pages."""

__version__ = "0.2.0"
