"""All queries over the driver tables, by name, with the SQL that gives the same rows."""

from __future__ import annotations

from . import forwarding, hybrid, ingest, pairs, records, relational, retrieval, scoring, streams

_PARTS = (relational, retrieval, scoring, records, pairs, streams, ingest, hybrid, forwarding)
QUERIES = {name: query for part in _PARTS for name, query in part.QUERIES.items()}
ORACLES = {name: text for part in _PARTS for name, text in part.ORACLES.items()}
