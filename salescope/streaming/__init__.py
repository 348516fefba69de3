"""Structured Streaming ingest of invoice files dropped into a landing folder."""
