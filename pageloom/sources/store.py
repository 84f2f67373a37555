"""The bookmark store: Parquet segments, deltas over them, and a manifest that says which count.

Ingest appends segments, so a run costs what it adds. An upsert writes a delta: its rows alone, which replace those of the same URL when the store is
read; of several deltas the last one with a URL counts. ``store_fold`` brings deltas into the segments: these are filed by a hash of the URL, and
only buckets that a delta touches are written again. A rebuild or a compaction writes all rows as the next version and leaves the files of
earlier ones alone. With a segment lie Bloom filters of its hashes (``pageloom.sources.filters``), so a small batch opens only segments that can
concern it. Every write ends with a manifest (``pageloom.sources.manifest``), so a reader never sees half of one, and writing a segment again
under its name replaces it.
"""

from __future__ import annotations

import datetime as dt
import functools
import logging
import uuid
from collections import Counter
from collections.abc import Collection

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.operators.numbering import first_per
from pageloom.operators.sizing import BROADCAST_ROWS, small_side
from pageloom.schema import STORE
from pageloom.sources import filters, fs, manifest

log = logging.getLogger(__name__)

#: Buckets of URL hashes that folded segments are filed under, unless the store says otherwise.
BUCKETS = 64
_EMPTY = {"version": 0, "segments": [], "deltas": [], "names": [], "max_key": 0}


def _state(spark: SparkSession, path: str) -> tuple[int, dict]:
    number, content = manifest.newest(spark, path)
    return number, {**_EMPTY, **content}


def current_version(spark: SparkSession, path: str) -> int | None:
    """Number of the newest version; appended segments belong to the version they extend."""
    return _state(spark, path)[1]["version"] or None


def _rows(spark: SparkSession, path: str, segments: list[dict]) -> DataFrame:
    if not segments:
        # The condition tells the optimizer that there is nothing.
        return spark.createDataFrame([], STORE).where(F.lit(False))
    return spark.read.schema(STORE).parquet(*[f"{path}/{s['path']}" for s in segments])


def _latest(spark: SparkSession, path: str, deltas: list[dict]) -> DataFrame:
    """The last row of each URL in the deltas; within one delta a URL stands once."""
    if len(deltas) == 1:
        return _rows(spark, path, deltas)
    found = spark.read.schema(f"{_ddl()}, seq BIGINT").option("basePath", f"{path}/delta").parquet(*[f"{path}/{d['path']}" for d in deltas])
    return first_per(found, "url_hash", F.col("seq").desc()).drop("seq")


def _merged(rows: DataFrame, latest: DataFrame, n: int) -> DataFrame:
    """Rows whose URL has no newer one, and the newer ones. A counted few are broadcast, so the rows stay where they are."""
    kept = rows.join(small_side(latest.select("url_hash"), small=n <= BROADCAST_ROWS), "url_hash", "left_anti")
    return kept.select(*STORE.names).unionByName(latest.select(*STORE.names))


def store_scan(spark: SparkSession, path: str) -> DataFrame:
    """All stored rows; an empty table when there is no store yet."""
    _, state = _state(spark, path)
    return _scanned(spark, path, state, state["segments"])


def _scanned(spark: SparkSession, path: str, state: dict, segments: list[dict]) -> DataFrame:
    rows = _rows(spark, path, segments)
    if not state["deltas"]:
        return rows
    return _merged(rows, _latest(spark, path, state["deltas"]), sum(d["rows"] for d in state["deltas"]))


def store_near(spark: SparkSession, path: str, hashes: DataFrame, column: str, without: Collection[str] = ()) -> DataFrame:
    """Stored rows among which are all that share a hash with ``hashes`` in ``column``, ``url_hash`` or ``content_hash``.

    Segments whose filter knows none of the hashes are not opened; a join decides about the rows of the others. Deltas are
    read whole, and what they replace is gone. More hashes than ``filters.LOOKED_UP`` get the whole store. The caller knows of segments named
    in ``without`` that they share no hash with ``hashes``.
    """
    _, state = _state(spark, path)
    asked = [s for s in state["segments"] if s.get("name") not in without]
    near = filters.segments_with(spark, path, asked, hashes, column)
    return _scanned(spark, path, state, asked if near is None else near)


def store_scan_permissive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows kept as JSON lines: the readable ones, and the text of the others."""
    lines = spark.read.text(path)
    parsed = lines.select(
        "value", F.from_json("value", F.lit(_ddl() + ", _corrupt STRING"), {
            "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt",
        }).alias("row"),
    )
    good = parsed.where("row IS NOT NULL AND row._corrupt IS NULL").select("row.*").drop("_corrupt")
    bad = parsed.where("row IS NULL OR row._corrupt IS NOT NULL").select(F.col("value").alias("record"))
    return good, bad


def _ddl() -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in STORE.fields)


def segment_committed(spark: SparkSession, path: str, segment: str) -> bool:
    """Whether the store ever got this segment."""
    return segment in _state(spark, path)[1]["names"]


def last_key(spark: SparkSession, path: str) -> int:
    """The highest key ever given in the store, 0 without any."""
    return _state(spark, path)[1]["max_key"]


def _written(rows: DataFrame, path: str, folder: str) -> tuple[int, int]:
    """Write rows in the order of keys; their number and highest key. Reading by key then skips most of the store."""
    spark = rows.sparkSession
    rows.select(*STORE.names).sortWithinPartitions("key").write.mode("overwrite").parquet(f"{path}/{folder}")
    done = spark.read.schema(STORE).parquet(f"{path}/{folder}")
    n, last = done.agg(F.count(F.lit(1)), F.max("key")).first()
    return n, last or 0


def _with_filter(rows: DataFrame, path: str, segments: list[dict], sizes: dict[str, int]) -> list[dict]:
    """The segments with a filter, written for all of them at once from ``rows`` with their ``segment``; ``sizes`` has the rows of each by its path."""
    bits = {s["path"]: filters.bits_for(sizes[s["path"]]) for s in segments}
    target = f"filter/{uuid.uuid4().hex[:12]}"
    known = F.create_map(*[F.lit(x) for pair in bits.items() for x in pair])
    filters.filters_write(rows.select("segment", known[F.col("segment")].alias("bits"), *filters.KINDS), f"{path}/{target}")
    return [{**s, "bits": bits[s["path"]], "filter": target} for s in segments]


def _filed(spark: SparkSession, path: str, entry: dict, n: int) -> dict:
    """A segment of ``n`` rows with its filter."""
    rows = _rows(spark, path, [entry]).withColumn("segment", F.lit(entry["path"]))
    return _with_filter(rows, path, [entry], {entry["path"]: n})[0]


def store_append(rows: DataFrame, path: str, segment: str) -> None:
    """Add rows as one segment. The same segment name replaces the segment."""
    spark = rows.sparkSession
    number, state = _state(spark, path)
    folder = f"added/seg={segment}-{uuid.uuid4().hex[:12]}"
    n, last = _written(rows, path, folder)
    added = _filed(spark, path, {"name": segment, "path": folder}, n)
    segments = _filters_merged(spark, path, [*_others(state, segment), added])
    manifest.commit(spark, path, number + 1, {
        **state, "version": state["version"] or 1, "segments": segments, "names": _names(state, segment),
        "max_key": max(state["max_key"], last),
    })


def store_pass(spark: SparkSession, path: str, segment: str) -> None:
    """Commit a segment without rows: its name alone."""
    number, state = _state(spark, path)
    segments, names = _others(state, segment), _names(state, segment)
    manifest.commit(spark, path, number + 1, {**state, "version": state["version"] or 1, "segments": segments, "names": names})


def _others(state: dict, segment: str) -> list[dict]:
    return [s for s in state["segments"] if s.get("name") != segment]


def _names(state: dict, segment: str) -> list[str]:
    return state["names"] if segment in state["names"] else [*state["names"], segment]


def _filters_merged(spark: SparkSession, path: str, segments: list[dict]) -> list[dict]:
    """The segments, their filters in fewer folders when there are enough folders of like size: a lookup opens few, however many segments there are."""
    held = Counter(s["filter"] for s in segments if "filter" in s)
    parts, least = [], 1
    while True:
        same = [f for f, n in held.items() if least <= n < least * filters.FANOUT]
        if len(same) + bool(parts) < filters.FANOUT:
            break
        parts, least = parts + same, least * filters.FANOUT
    if not parts:
        return segments
    target = f"filter/{uuid.uuid4().hex[:12]}"
    filters.filters_merge(spark, [f"{path}/{f}" for f in parts], f"{path}/{target}")
    return [{**s, "filter": target} if s.get("filter") in parts else s for s in segments]


def store_delta(rows: DataFrame, path: str) -> int:
    """Add rows with keys and unique URLs that replace those of the same URL; the new version. Only they are written."""
    spark = rows.sparkSession
    number, state = _state(spark, path)
    folder = f"delta/seq={number + 1}"
    n, last = _written(rows, path, folder)
    version = state["version"] + 1
    deltas = [*state["deltas"], {"path": folder, "rows": n}] if n else state["deltas"]
    manifest.commit(spark, path, number + 1, {**state, "version": version, "deltas": deltas, "max_key": max(state["max_key"], last)})
    return version


def store_replace(rows: DataFrame, path: str) -> int:
    """Write ``rows`` as the next version; ``rows`` may read the current one."""
    spark = rows.sparkSession
    number, state = _state(spark, path)
    version = state["version"] + 1
    folder = f"v={version:06d}/{uuid.uuid4().hex[:12]}"
    n, last = _written(rows, path, folder)
    manifest.commit(spark, path, number + 1, {
        **state, "version": version, "segments": [_filed(spark, path, {"path": folder}, n)], "deltas": [], "max_key": max(state["max_key"], last),
    })
    return version


def store_rebuild(df: DataFrame, path: str) -> None:
    """Start over: the next version holds ``df`` only."""
    store_replace(df, path)


def store_compact(spark: SparkSession, path: str, segments: int = 1) -> int | None:
    """Bring more than ``segments`` segments and deltas together as the next version, in key order; its number, or None when there is nothing to do.

    Segments of earlier versions still count as committed, so a stream that runs a batch again adds nothing twice.
    """
    _, state = _state(spark, path)
    if len(state["segments"]) + len(state["deltas"]) <= segments:
        return None
    return store_replace(store_scan(spark, path).repartitionByRange("key"), path)


def store_fold(spark: SparkSession, path: str, buckets: int = BUCKETS) -> int | None:
    """Bring the deltas into the segments as the next version; its number, or None without deltas.

    Segments are filed by a hash of the URL. Buckets that no delta and no appended segment touches keep their files, so what is written
    follows from what has changed; the first fold files all. The number of buckets is settled by it.
    """
    number, state = _state(spark, path)
    if not state["deltas"]:
        return None
    buckets = state.get("buckets", buckets)
    bucket = F.pmod(F.xxhash64("url_hash"), F.lit(buckets)).cast("int")
    latest = _latest(spark, path, state["deltas"])
    loose = [s for s in state["segments"] if "bucket" not in s]
    changed = latest.select("url_hash").unionByName(_rows(spark, path, loose).select("url_hash"))
    touched = {r[0] for r in changed.select(bucket).distinct().collect()}
    old = [s for s in state["segments"] if s.get("bucket") in touched or "bucket" not in s]
    rows = _merged(_rows(spark, path, old), latest, sum(d["rows"] for d in state["deltas"])).withColumn("bucket", bucket)
    version = state["version"] + 1
    folder = f"v={version:06d}/{uuid.uuid4().hex[:12]}"
    filed = rows.hint("rebalance", "bucket").sortWithinPartitions("bucket", "key")
    filed.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/{folder}")
    new = [{"path": f"{folder}/{name}", "bucket": int(name.split("=")[1])} for name in fs.subfolders(spark, f"{path}/{folder}")]
    made = spark.read.schema(f"{_ddl()}, bucket INT").parquet(f"{path}/{folder}")
    made = made.withColumn("segment", F.concat(F.lit(f"{folder}/bucket="), "bucket"))
    new = _with_filter(made, path, new, {r["segment"]: r["count"] for r in made.groupBy("segment").count().collect()})
    untouched = [s for s in state["segments"] if "bucket" in s and s["bucket"] not in touched]
    manifest.commit(spark, path, number + 1, {**state, "version": version, "segments": [*untouched, *new], "deltas": [], "buckets": buckets})
    return version


def _fingerprint(df: DataFrame) -> tuple:
    row = df.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)"))).first()
    return tuple(row)


def store_snapshot(
    spark: SparkSession,
    path: str,
    base: str,
    op_name: str = "pre_write_backup",
    stop_on_failure: bool = False,
    now: dt.datetime | None = None,
) -> str | None:
    """Copy the store to ``<base>/store_backup_<time>_<op_name>`` and compare copy and original.

    None when there is nothing to copy. A failed copy is logged, or raised with
    ``stop_on_failure``.
    """
    store = store_scan(spark, path)
    if store.isEmpty():
        return None
    stamp = (now or dt.datetime.now()).strftime("%Y%m%d_%H%M%S")
    target = f"{base}/store_backup_{stamp}_{op_name}"
    try:
        store.write.mode("errorifexists").parquet(target)
        copy = spark.read.schema(STORE).parquet(target)
        if _fingerprint(copy) != _fingerprint(store):
            raise OSError(f"backup {target} differs from the store")
    except Exception as error:
        if stop_on_failure:
            raise
        log.warning("backup failed, going on: %s", error)
        return None
    return target
