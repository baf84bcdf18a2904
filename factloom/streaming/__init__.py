"""Structured Streaming: incremental ingest, progress, and windows (an extension)."""
