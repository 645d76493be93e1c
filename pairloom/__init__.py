"""Parallel-text analytics on Spark: ingest, curate, score and compare sentence pairs."""

__version__ = "0.1.0"
