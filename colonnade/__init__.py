"""Sequence-alignment analytics on Spark DataFrames."""
