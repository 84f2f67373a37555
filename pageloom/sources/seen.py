"""The memory of URLs that were tried, stored or not.

A page that failed and is not stored, or whose content was stored under another URL, leaves no row of its own. Its URL's hash stays here, a
segment per run, so it is not tried again. A segment is written before the run's rows are committed and replaced when the run starts again.
Segments of runs that are over are brought together, eight of like size at a time; a manifest says which are in what was written for them. So a
reader opens few folders, however many runs there were, and a hash is written about log8(runs) times.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.sources import fs, manifest

#: So many segments of like size become one.
FANOUT = 8
_DDL = "url_hash STRING"


def _folder(segment: str) -> str:
    return f"seg={segment}"


def _state(spark: SparkSession, path: str) -> tuple[int, list[dict]]:
    """Number of the newest manifest, and the folders it has with the segments in each."""
    number, content = manifest.newest(spark, path)
    if "folders" in content:
        return number, content["folders"]
    # Segments of before there was a manifest.
    found = [s for s in fs.subfolders(spark, path) if s.startswith("seg=") and fs.exists(spark, f"{path}/{s}/_SUCCESS")]
    return number, [{"path": s, "level": 0, "names": [s.removeprefix("seg=")]} for s in found]


def seen_scan(spark: SparkSession, path: str, without: str | None = None) -> DataFrame:
    """Hashes of all URLs tried, those of the segment ``without`` left out, which must not be merged."""
    _, folders = _state(spark, path)
    done = [f"{path}/{f['path']}" for f in folders if f["names"] != [without]]
    return spark.read.schema(_DDL).parquet(*done) if done else spark.createDataFrame([], _DDL).where(F.lit(False))


def seen_names(spark: SparkSession, path: str) -> set[str]:
    """Names of the segments whose hashes are here."""
    return {n for f in _state(spark, path)[1] for n in f["names"]}


def seen_append(hashes: DataFrame, path: str, segment: str) -> None:
    """Remember the ``url_hash`` of a run. The same segment name replaces the segment."""
    spark = hashes.sparkSession
    hashes.select("url_hash").distinct().write.mode("overwrite").parquet(f"{path}/{_folder(segment)}")
    number, folders = _state(spark, path)
    others = [f for f in folders if f["names"] != [segment]]
    manifest.commit(spark, path, number + 1, {"folders": [*others, {"path": _folder(segment), "level": 0, "names": [segment]}]})


def seen_merge(spark: SparkSession, path: str, over: Callable[[str], bool]) -> None:
    """Bring segments together when there are enough of like size; ``over`` says of a name that its run will not start again."""
    number, folders = _state(spark, path)
    parts = [f for f in folders if f["level"] == 0 and all(map(over, f["names"]))]
    if len(parts) < FANOUT:
        return
    level = 1
    while len(same := [f for f in folders if f["level"] == level]) >= FANOUT - 1:
        parts += same
        level += 1
    made = {"path": f"merged/{uuid.uuid4().hex[:12]}", "level": level, "names": [n for f in parts for n in f["names"]]}
    spark.read.schema(_DDL).parquet(*[f"{path}/{f['path']}" for f in parts]).distinct().write.parquet(f"{path}/{made['path']}")
    manifest.commit(spark, path, number + 1, {"folders": [*[f for f in folders if f not in parts], made]})
