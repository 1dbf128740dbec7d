"""Structured Streaming front of the incremental ingestion."""
