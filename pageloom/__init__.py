"""Pageloom: bookmarks and fetched web pages as a searchable set of Spark tables."""
