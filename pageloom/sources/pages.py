"""Fetched and rendered pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pageloom.schema import PAGE


def page_scan(spark: SparkSession, path: str) -> DataFrame:
    """Responses ``(page_id, url, html, content_type, status)``; columns a file lacks are NULL."""
    return spark.read.schema(PAGE).parquet(path)
