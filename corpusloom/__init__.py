"""Corpus preparation and token analytics on Spark."""
