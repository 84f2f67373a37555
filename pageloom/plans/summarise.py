"""Summaries for stored rows."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.operators.numbering import first_per
from pageloom.operators.ordering import summary_limit
from pageloom.operators.summaries import prompt_build, stored_summaries, summary_apply, summary_backlog
from pageloom.operators.upsert import store_upsert, upsert_into
from pageloom.schema import SUMMARY
from pageloom.session import staged
from pageloom.sources import fs
from pageloom.sources.store import store_scan


def summarise(
    store: DataFrame, fn: Callable[[pd.Series], pd.Series], model: str, force: bool = False,
    limit: int | None = None, summary_time: Column | None = None,
) -> DataFrame:
    """The store after summaries were made for the rows that need one.

    Answers are staged before anything looks at them twice, so no prompt is sent
    again.
    """
    return store_upsert(store, _made(store, fn, model, force, limit, summary_time), order="key")


def _made(
    store: DataFrame, fn: Callable[[pd.Series], pd.Series], model: str, force: bool = False, limit: int | None = None, summary_time: Column | None = None
) -> DataFrame:
    """Rows with the summaries that could be made."""
    considered = summary_limit(store, limit) if limit else store
    backlog = prompt_build(summary_backlog(considered, force))
    return stored_summaries(staged(summary_apply(backlog, fn, model, summary_time), "summaries"))


def summarise_store(spark: SparkSession, path: str, fn: Callable[[pd.Series], pd.Series], model: str, **options) -> int:
    """Make the missing summaries of a stored table; its next version. Only rows that got one are written."""
    return upsert_into(_made(store_scan(spark, path), fn, model, **options), path, order="key")


def summary_scan(spark: SparkSession, path: str) -> DataFrame:
    """Summaries kept beside the store, segment by segment."""
    names = [s for s in fs.subfolders(spark, path) if s.startswith("seg=")]
    done = [f"{path}/{s}" for s in names if fs.exists(spark, f"{path}/{s}/_SUCCESS")]
    return spark.read.schema(SUMMARY).parquet(*done) if done else spark.createDataFrame([], SUMMARY)


def with_summaries(store: DataFrame, summaries: DataFrame) -> DataFrame:
    """The store with the latest summary of each URL from the side table."""
    names = ("summary", "summary_model", "summary_time")
    latest = first_per(summaries, "url_hash", F.col("summary_time").desc(), F.col("summary")).select(
        "url_hash", F.struct(*names).alias("_made")
    )
    joined = store.join(latest, "url_hash", "left")
    newest = {n: F.when(F.col("_made").isNotNull(), F.col(f"_made.{n}")).otherwise(F.col(n)) for n in names}
    return joined.withColumns(newest).select(*store.columns)
