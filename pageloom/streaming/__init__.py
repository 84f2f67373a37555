"""Continuous ingest and summaries."""
