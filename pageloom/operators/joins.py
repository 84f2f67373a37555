"""Joins of the ingest, and lookups in the store."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import content_hash
from pageloom.functions.urls import url_hash, video_id_extract
from pageloom.operators.numbering import first_per
from pageloom.operators.sizing import BROADCAST_ROWS, holds_at_most, local_column

# Snippets per part of a transcript. A part is what one task puts together.
PART_SNIPPETS = 4096


def concerned(store: DataFrame, batch: DataFrame, column: str, small: bool | None = None) -> DataFrame:
    """The rows of ``store`` that share a hash with the batch, at least.

    A small batch picks them where they lie: its hashes are broadcast, and the
    store, which may be any size, is not shuffled. For a large batch the store
    is returned as it is and the join that follows shuffles both.
    """
    if small is None:
        small = holds_at_most(batch.select(column), BROADCAST_ROWS)
    return store.join(F.broadcast(batch.select(column).distinct()), column, "left_semi") if small else store


def _unknown(new: DataFrame, store: DataFrame, column: str, small: bool | None) -> DataFrame:
    known = concerned(store.select(column).where(F.col(column).isNotNull()), new, column, small)
    return new.join(known, column, "left_anti")


def unmet(values: list[str], table: DataFrame, column: str) -> list[str]:
    """Those of a few different hashes that ``table`` lacks. It is filtered where it lies; the hashes it has come back."""
    if not values:
        return values
    asked = F.broadcast(local_column(table.sparkSession, values, column))
    met = {r[0] for r in table.select(column).join(asked, column, "left_semi").collect()}
    return [v for v in values if v not in met]


def with_url_hash(df: DataFrame) -> DataFrame:
    """``df`` with the hash of its URL; one that is there is not made again."""
    return df if "url_hash" in df.columns else df.withColumn("url_hash", url_hash(F.col("url")))


def with_content_hash(df: DataFrame) -> DataFrame:
    """``df`` with the hash of its content; one that is there is not made again."""
    return df if "content_hash" in df.columns else df.withColumn("content_hash", content_hash(F.col("content")))


def incremental_url_antijoin(new: DataFrame, store: DataFrame, small: bool | None = None) -> DataFrame:
    """Bookmarks whose URL is not in the store yet. Of the store only hashes are read."""
    return _unknown(with_url_hash(new), with_url_hash(store), "url_hash", small)


def content_antijoin(new: DataFrame, store: DataFrame, small: bool | None = None) -> DataFrame:
    """Pages whose content is not in the store yet. Of the store only hashes are read."""
    return _unknown(with_content_hash(new), with_content_hash(store), "content_hash", small)


def index_update_antijoin(docs: DataFrame, index_docs: DataFrame) -> DataFrame:
    """Documents whose key is not in the index; those that are there stay as they were."""
    return docs.join(index_docs.select("key"), "key", "left_anti")


def existing_summary_join(df: DataFrame, store: DataFrame) -> DataFrame:
    """Bring the stored summary of each URL as ``stored_summary``."""
    stored = store.select("url", F.col("summary").alias("stored_summary"))
    return df.join(stored, "url", "left")


def failed_bookmark_join(bookmarks: DataFrame, failed: DataFrame) -> DataFrame:
    """Bookmarks with a failure, as rows that carry the reason."""
    order = F.col("pos" if "pos" in failed.columns else "reason")
    reasons = first_per(failed, "url", order).select("url", F.col("reason").alias("error"))
    return bookmarks.join(reasons, "url")


def transcript_format(snippets: DataFrame, part_snippets: int = PART_SNIPPETS) -> DataFrame:
    """Snippets ``(video_id, pos, text)`` to text, a line each: ``(video_id, part, transcript)``.

    A part covers a fixed range of positions. That bounds what a task collects,
    and the snippets of a very long video spread over many tasks. Parts in
    order are the whole transcript; nearly every video has just one.
    """
    in_part = snippets.withColumn("part", F.floor(F.col("pos") / part_snippets))
    lines = F.sort_array(F.collect_list(F.struct("pos", F.coalesce("text", F.lit("")).alias("text"))))
    return in_part.groupBy("video_id", "part").agg(
        F.array_join(F.transform(lines, lambda s: s["text"]), "\n").alias("transcript")
    )


def transcript_cells(parts: DataFrame) -> DataFrame:
    """Put the parts of each video into one cell, whole.

    A cell holds 2 GB; a job that meets a longer transcript fails instead of leaving it out. Such
    videos are worked on in the parts table.
    """
    sizes = parts.groupBy("video_id").agg(F.count(F.lit(1)).alias("transcript_parts"))
    fitting = sizes.where(F.col("transcript_parts") > 1)
    single = sizes.where(F.col("transcript_parts") == 1)
    joined = (
        parts.join(fitting.select("video_id"), "video_id", "left_semi")
        .groupBy("video_id")
        .agg(F.sort_array(F.collect_list(F.struct("part", "transcript"))).alias("pieces"))
        .select("video_id", F.array_join(F.transform("pieces", lambda p: p["transcript"]), "\n").alias("transcript"))
    )
    alone = parts.join(single.select("video_id"), "video_id", "left_semi").select("video_id", "transcript")
    return sizes.select("video_id", "transcript_parts").join(alone.unionByName(joined), "video_id", "left")


def video_metadata_join(bookmarks: DataFrame, meta: DataFrame, transcripts: DataFrame) -> DataFrame:
    """Set ``description`` of video bookmarks from metadata and transcript.

    ``meta(video_id, description)`` and ``transcripts(video_id, transcript)``
    have one row per video. Rows without metadata keep their description. Only
    rows with a video id take part in the joins, so the many without one do not
    meet in one task.
    """
    if "description" not in bookmarks.columns:
        bookmarks = bookmarks.withColumn("description", F.lit(None).cast("string"))
    with_id = bookmarks.withColumn("video_id", video_id_extract(F.col("url")))
    others = with_id.where("video_id IS NULL")
    facts = meta.select("video_id", F.coalesce("description", F.lit("")).alias("_about")).join(
        transcripts.select("video_id", F.coalesce("transcript", F.lit("")).alias("_said")), "video_id", "left"
    )
    about, said = F.col("_about"), F.coalesce("_said", F.lit(""))
    text = (
        F.when(about.isNull(), F.col("description"))
        .when(said == "", about)
        .when(about == "", said)
        .otherwise(F.concat(about, F.lit("\n\n"), said))
    )
    videos = (
        with_id.where("video_id IS NOT NULL")
        .join(facts, "video_id", "left")
        .withColumn("description", text)
        .drop("_about", "_said")
    )
    return videos.unionByName(others).drop("video_id")


def _lookup(store: DataFrame, condition: Column, limit: int | None, index: DataFrame | None) -> DataFrame:
    if limit is None:
        if index is None:
            return store.where(condition).orderBy("key")
        keys = index.where(condition).select(F.explode("keys").alias("key"))
        return store.join(keys, "key", "left_semi").orderBy("key")
    if index is None:
        return store.where(condition).orderBy("key").limit(limit)
    first = index.where(condition).orderBy("block").limit(limit)
    keys = [r[0] for r in first.select(F.explode("keys").alias("key")).orderBy("key").limit(limit).collect()]
    return store.where(F.col("key").isin(keys) if keys else F.lit(False)).orderBy("key").limit(limit)


def lookup_by_domain(store: DataFrame, domain: str, limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """The bookmarks of a domain, by key; with ``limit`` the first ones.

    With a domain index the keys are looked up there and only those rows of the store are read.
    """
    return _lookup(store, F.col("domain") == domain.lower(), limit, index)


def lookup_by_date(store: DataFrame, date: str, limit: int | None = None, index: DataFrame | None = None) -> DataFrame:
    """The bookmarks of a day, by key; with a date index like ``lookup_by_domain``."""
    return _lookup(store, F.col("date") == F.lit(date).cast("date"), limit, index)


def latest_per_url(df: DataFrame, order: str) -> DataFrame:
    """Last row per URL, found by the hash by which stores are joined, so the rows need not move again."""
    return first_per(with_url_hash(df), "url_hash", F.col(order).desc())
