"""Vehicle event analytics on Spark: ingest checks, tagging, rollups, alerts and reports."""

__version__ = "0.1.0"
