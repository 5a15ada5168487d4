"""Structured Streaming: ingest, tail, stream dedup, container lifecycle."""
