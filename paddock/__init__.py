"""Livestock auction lot-price analytics on Spark DataFrames."""
