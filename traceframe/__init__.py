"""Event-trace analytics on Spark: ingest, quality rules, windows, lineage."""

__version__ = "0.1.0"
