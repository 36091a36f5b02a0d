"""Synteny analytics between two annotated genomes, as Spark DataFrames."""
