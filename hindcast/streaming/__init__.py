"""Structured Streaming forms of ingestion, intervals and windowed counts."""
