"""All registered queries."""

from __future__ import annotations

from checks import call_queries, conversation_queries, ingest_queries, metrics_queries, text_queries

_PARTS = [metrics_queries, text_queries, conversation_queries, ingest_queries, call_queries]
QUERIES = {name: q for part in _PARTS for name, q in part.QUERIES.items()}
SQL = {name: q for part in _PARTS for name, q in part.SQL.items()}
