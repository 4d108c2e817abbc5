"""Gatherlake: building and querying a catalog of public events on Spark."""
