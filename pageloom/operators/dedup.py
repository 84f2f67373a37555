"""First-wins de-duplication.

Position is an explicit column of the input, so the outcome does not depend on
the order in which tasks finish.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.operators.joins import with_content_hash, with_url_hash
from pageloom.operators.numbering import first_per


def url_dedup(df: DataFrame, order: str = "pos") -> DataFrame:
    """First bookmark per URL."""
    return first_per(with_url_hash(df), "url_hash", F.col(order), F.col("url"))


def content_dedup(df: DataFrame, order: str = "pos") -> DataFrame:
    """First page per content."""
    return first_per(with_content_hash(df), "content_hash", F.col(order))


def index_key_dedup(docs: DataFrame, order: str = "pos") -> tuple[DataFrame, DataFrame]:
    """First document per key, and the counts of one index build."""
    kept = first_per(docs, "key", F.col(order))
    per_key = docs.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    counts = per_key.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("processed"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )
    return kept, counts
