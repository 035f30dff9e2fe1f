"""Structured Streaming jobs: ingest, live metrics, live assembly of replies."""
