"""DataFrame operators of the ingest and the store."""
