"""Agent-memory analytics on PySpark: retrieval, maintenance, graph, ingest and streaming operators."""
