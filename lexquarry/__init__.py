"""Regex search and text-gram analytics on Spark DataFrames."""
