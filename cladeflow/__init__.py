"""Cladeflow: hierarchical classification and profiling of alignments on Spark DataFrames."""

__version__ = "0.1.0"
