"""Chunk-dedup and content-addressed storage analytics on Spark DataFrames."""
