"""All queries of the core, each beside the SQL that checks it."""

from __future__ import annotations

from mnemolith.operators import graph, lifecycle, maintenance, references, retrieval, search
from mnemolith.sources import ingest
from mnemolith.streaming import events

_MODULES = (references, retrieval, search, maintenance, graph, lifecycle, ingest, events)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
