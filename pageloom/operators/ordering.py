"""Sorts and limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.operators.numbering import first_rows


def bookmark_sort(df: DataFrame, order: str = "pos") -> DataFrame:
    """By folder and title, both descending and NULL as empty; equal ones keep their order.

    The position as last sort key also lets the range partitioning split a
    folder full of equal titles.
    """
    return df.orderBy(
        F.coalesce(F.col("folder"), F.lit("")).desc(), F.coalesce(F.col("title"), F.lit("")).desc(), F.col(order)
    )


def crawl_limit(df: DataFrame, n: int, order: str = "pos") -> DataFrame:
    """The first ``n`` new rows; duplicates are gone before and do not count."""
    return first_rows(df, n, order)


def summary_limit(store: DataFrame, n: int) -> DataFrame:
    """The first ``n`` stored rows."""
    return first_rows(store, n, "key")
