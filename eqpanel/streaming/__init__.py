"""Structured Streaming ingest and bar building."""
