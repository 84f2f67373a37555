"""Secondary indexes, statistics and reports. All of them aggregate before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.functions.urls import PLAIN, RENDERED
from pageloom.operators.numbering import number_rows

# Consecutive keys per row of a secondary index. Keys are unique, so a row
# never lists more than this many and a big domain spreads over many rows.
BLOCK_KEYS = 4096


def _key_blocks(store: DataFrame, by: str, block_keys: int) -> DataFrame:
    block = F.floor(F.col("key") / block_keys).alias("block")
    return store.groupBy(by, block).agg(F.sort_array(F.collect_set("key")).alias("keys"))


def domain_index_build(store: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``(domain, block, keys)``; the rows of a domain together are its set of keys."""
    return _key_blocks(store.where(F.col("domain") != ""), "domain", block_keys)


def date_index_build(store: DataFrame, block_keys: int = BLOCK_KEYS) -> DataFrame:
    """``(date, block, keys)``; the rows of a day together are its set of keys."""
    return _key_blocks(store.where(F.col("date").isNotNull()), "date", block_keys)


def domain_stats(store: DataFrame) -> DataFrame:
    """Bookmarks per domain."""
    return store.where(F.col("domain") != "").groupBy("domain").agg(F.count(F.lit(1)).alias("n"))


def date_stats(store: DataFrame) -> DataFrame:
    """Bookmarks per day."""
    return store.where(F.col("date").isNotNull()).groupBy("date").agg(F.count(F.lit(1)).alias("n"))


def content_length_stats(store: DataFrame) -> DataFrame:
    """Average, longest and shortest content; a row without content counts as 0."""
    length = F.coalesce(F.col("content_length"), F.lit(0))
    return store.agg(
        F.avg(length).alias("avg_length"), F.max(length).alias("max_length"), F.min(length).alias("min_length")
    )


def crawl_method_counts(store: DataFrame) -> DataFrame:
    """Rows per crawl method, one column each."""
    return store.agg(
        F.count_if(F.col("crawl_method") == RENDERED).alias(RENDERED),
        F.count_if(F.col("crawl_method") == PLAIN).alias(PLAIN),
    )


def failure_report(failed: DataFrame, order: str = "pos") -> DataFrame:
    """Numbered lines ``n. title - url - Reason: reason``."""
    numbered = number_rows(failed.select(order, "url", "title", "reason"), order, "n")
    line = F.concat(
        F.col("n").cast("string"), F.lit(". "), F.coalesce("title", F.lit("No Title")),
        F.lit(" - "), F.col("url"), F.lit(" - Reason: "), F.col("reason"),
    )
    return numbered.select("n", line.alias("line"))


def failure_counts(failed: DataFrame) -> DataFrame:
    """Failures per reason."""
    return failed.groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def run_summary(valid: DataFrame, stored: DataFrame, skipped: DataFrame, failed: DataFrame) -> DataFrame:
    """One row with the counts of a run."""
    parts = {"valid": valid, "stored": stored, "skipped": skipped, "failed": failed}
    tagged = None
    for name, df in parts.items():
        part = df.select(F.lit(name).alias("part"))
        tagged = part if tagged is None else tagged.unionByName(part)
    return tagged.agg(*[F.count_if(F.col("part") == name).alias(name) for name in parts])
