"""Inference-log analytics on Spark: ingest, metrics, conversations and call records."""
