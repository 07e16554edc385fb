"""Gleaner: full-text search and page analytics written directly on Spark DataFrames."""

__version__ = "0.1.0"
