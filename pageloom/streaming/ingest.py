"""Structured Streaming around the batch operators."""

from __future__ import annotations

import json
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from pageloom.operators.dedup import url_dedup
from pageloom.operators.joins import incremental_url_antijoin
from pageloom.operators.sizing import BROADCAST_ROWS, holds_at_most
from pageloom.operators.summaries import prompt_build, stored_summaries, summary_apply, summary_backlog
from pageloom.plans.ingest import at_store, ingest
from pageloom.plans.summarise import summary_scan
from pageloom.schema import FAILURE, SUMMARY
from pageloom.sources import fs, manifest
from pageloom.sources.seen import seen_append, seen_merge, seen_names, seen_scan
from pageloom.sources.store import segment_committed, store_append, store_pass, store_scan

FLUSH_INTERVAL = "60 seconds"
AVAILABLE_NOW = "available_now"
BATCH_DIGITS = 12


def _started(writer, trigger: str) -> StreamingQuery:
    if trigger == AVAILABLE_NOW:
        return writer.trigger(availableNow=True).start()
    return writer.trigger(processingTime=trigger).start()


def _segment(spark: SparkSession, checkpoint: str, batch_id: int) -> str:
    """The name of a batch: the id of the stream in this checkpoint, and the batch's number.

    Numbers start again with every new checkpoint; the id keeps two streams from taking each other's batches for done.
    """
    stream = json.loads(fs.read_text(spark, f"{checkpoint}/metadata"))["id"]
    return f"{stream}-{batch_id:0{BATCH_DIGITS}d}"


def stream_url_dedup(batch: DataFrame, store: DataFrame, order: str = "pos") -> DataFrame:
    """Bookmarks of a micro-batch that are new: first per URL, and not in the store.

    The store is the memory of earlier batches, so the stream keeps no state.
    """
    small = holds_at_most(batch.select("url"), BROADCAST_ROWS)
    return incremental_url_antijoin(url_dedup(batch, order), store, small)


def stream_page_ingest(
    pages_stream: DataFrame,
    store_path: str,
    checkpoint: str,
    trigger: str = FLUSH_INTERVAL,
    crawl_time: Column | None = None,
    name: str = "pages",
    remember: bool = True,
    **options,
) -> StreamingQuery:
    """Ingest fetched pages as they arrive; each micro-batch adds one segment to the store.

    The stream has the columns of a bookmark (``pos, url, name, type,
    date_added``) and of its response (``html, content_type, status``). A batch
    that runs again after a failure finds its segment and does nothing, or none
    and computes the same rows, so a restart with the same checkpoint resumes
    where the store ends. Failures go first, the segment is the commit. Unless
    ``remember`` is off, a URL is tried once, whether or not a row of it was
    stored; hashes of what was tried lie beside the store. A batch in which all URLs are known commits its name and no more.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        segment = f"{name}-{_segment(spark, checkpoint, batch_id)}"
        if segment_committed(spark, store_path, segment):
            return
        bookmarks = batch.drop("html", "content_type", "status")
        pages = batch.withColumn("page_id", F.col("pos"))
        when = F.current_timestamp() if crawl_time is None else crawl_time
        memory, seen, tried = f"{store_path}/seen", None, []

        def over(other: str) -> bool:
            """Earlier batches of this stream are committed and never run again."""
            return other.startswith(segment[:-BATCH_DIGITS]) and other < segment

        if remember:
            seen_merge(spark, memory, over)
            seen, tried = seen_scan(spark, memory, without=segment), [s for s in seen_names(spark, memory) if over(s)]
        done = ingest(bookmarks, pages, None, when, seen=seen, **at_store(spark, store_path, tried), **options)
        if done.nothing:
            store_pass(spark, store_path, segment)
            return
        if remember:
            seen_append(done.tried, memory, segment)
        done.failures.write.mode("overwrite").parquet(f"{store_path}/failed/seg={segment}")
        store_append(done.rows, store_path, segment)

    return _started(pages_stream.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint), trigger)


def stream_failures(spark: SparkSession, store_path: str) -> DataFrame:
    """Failures of all batches of the page stream."""
    base = f"{store_path}/failed"
    done = [f"{base}/{s}" for s in fs.subfolders(spark, base) if fs.exists(spark, f"{base}/{s}/_SUCCESS")]
    return spark.read.schema(FAILURE).parquet(*done) if done else spark.createDataFrame([], FAILURE)


def store_commits(spark: SparkSession, store_path: str) -> DataFrame:
    """A row for each commit of a store, as they are made: the sign that there may be work. Rows of the store do not go through the stream."""
    return spark.readStream.schema("value STRING").option("wholetext", True).text(f"{store_path}/{manifest.FOLDER}")


def stream_summary_backlog(
    spark: SparkSession,
    store_path: str,
    fn: Callable[[pd.Series], pd.Series],
    model: str,
    summaries_path: str,
    checkpoint: str,
    trigger: str = FLUSH_INTERVAL,
    summary_time: Column | None = None,
) -> StreamingQuery:
    """Summaries for stored rows, kept in a narrow table beside the store.

    A commit of the store starts a batch. It takes all rows that have no summary yet, in the store or beside it, so a prompt that failed comes
    again with the next commit, and rewriting the store costs no second prompt. The wide store is not rewritten; ``with_summaries`` brings both
    together.
    """

    def flush(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        target = f"{summaries_path}/seg={_segment(session, checkpoint, batch_id)}"
        if fs.exists(session, f"{target}/_SUCCESS"):
            return
        rows = store_scan(session, store_path)
        todo = summary_backlog(incremental_url_antijoin(rows, summary_scan(session, summaries_path)))
        made = stored_summaries(summary_apply(prompt_build(todo), fn, model, summary_time))
        made.select(*SUMMARY.names).write.mode("overwrite").parquet(target)

    commits = store_commits(spark, store_path)
    return _started(commits.writeStream.foreachBatch(flush).option("checkpointLocation", checkpoint), trigger)
