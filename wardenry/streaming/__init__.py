"""Structured Streaming forms of ingestion, topic consumption and windowed metrics."""
