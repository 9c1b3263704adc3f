"""Genome-annotation analytics and training-data operators on Spark DataFrames."""

__version__ = "0.2.0"
