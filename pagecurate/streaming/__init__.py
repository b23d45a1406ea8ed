"""Incremental ingest of records as they arrive (Structured Streaming)."""
