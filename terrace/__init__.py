"""Terrace: gridded and scattered measurements, and text corpora, as Spark DataFrames."""
