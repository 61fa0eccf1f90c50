"""Extraction of typed tables from recognised text, and training-data operators, as Spark jobs."""
