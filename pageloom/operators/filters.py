"""Row filters of the ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.schema import REASON_NON_TEXT

# Folder titles of browser extensions, addresses of a private
# network, and the content types that hold text.
EXTENSION_NAME = "扩展程序"
EXTENSION_FOLDER = "Extensions"
PRIVATE_URL = r"^https?://10[.]0[.]"
TEXT_TYPES = ("text/html", "text/plain")


def eligible_url_filter(df: DataFrame) -> DataFrame:
    """Bookmarks worth fetching."""
    return df.where(
        (F.col("url") != "")
        & (F.col("type") == "url")
        & (F.coalesce(F.col("name"), F.lit("")) != EXTENSION_NAME)
        & ~F.col("url").rlike(PRIVATE_URL)
    )


def folder_filter(df: DataFrame, excluded: str = EXTENSION_FOLDER) -> DataFrame:
    """Bookmarks with a URL that sit outside the excluded folder."""
    return df.where(
        (F.col("url") != "")
        & (F.col("type") == "url")
        & (F.coalesce(F.col("folder"), F.lit("")) != excluded)
    )


def is_text_type(content_type: Column) -> Column:
    """True for the content types that hold text, whatever their case and parameters."""
    lowered = F.lower(F.coalesce(content_type, F.lit("")))
    hit = F.lit(False)
    for kind in TEXT_TYPES:
        hit = hit | (F.instr(lowered, kind) > 0)
    return hit


def non_text_reason(content_type: Column) -> Column:
    """The failure reason that names the content type."""
    head, tail = REASON_NON_TEXT.split("%s")
    return F.concat(F.lit(head), F.coalesce(content_type, F.lit("")), F.lit(tail))


def content_type_filter(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split responses into text pages and failures that name the content type."""
    is_text = is_text_type(F.col("content_type"))
    return df.where(is_text), df.where(~is_text).withColumn("reason", non_text_reason(F.col("content_type")))
