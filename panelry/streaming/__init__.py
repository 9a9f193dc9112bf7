"""Structured Streaming forms of the ingest, bar and monitoring operators."""
