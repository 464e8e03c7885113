"""Hybrid retrieval and document processing on Spark DataFrames."""

__version__ = "0.1.0"
