"""Incremental runs as Structured Streaming."""
