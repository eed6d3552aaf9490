"""Spark-native analytics over genomic intervals and sparse feature-by-cell tables."""

__version__ = "0.1.0"
