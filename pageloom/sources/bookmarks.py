"""Bookmark exports."""

from __future__ import annotations

import logging

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pageloom.functions.dates import epoch_text, iso_text
from pageloom.schema import MISSING, RAW_BOOKMARK

log = logging.getLogger(__name__)

# Positions of one export stay below 2 to the power of this.
EXPORT_BITS = 40

# The browsers an export can come from.
SOURCES = ("chrome", "firefox", "edge", "opera", "opera_gx", "safari", "vivaldi", "brave")


def _read(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".json"):
        fields = [f for f in RAW_BOOKMARK.fields if f.name != "source"]
        written = [T.StructField(name, T.StringType()) for name in ("name", "date_added")]
        head = spark.read.text(path).where("trim(value) <> ''").first()
        array = head is not None and head[0].lstrip().startswith("[")
        # An array is one file, which one task reads in order.
        rows = spark.read.schema(T.StructType(fields + written)).option("multiLine", array).json(path)
        filled = {
            "pos": F.coalesce("pos", F.monotonically_increasing_id()),
            "title": F.coalesce("title", "name"),
            "ts": F.coalesce("ts", F.try_to_timestamp("date_added")),
        }
        return rows.withColumns(filled).select(*[f.name for f in fields])
    return spark.read.parquet(path)


def bookmark_union(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Union the exports of several browsers; one that cannot be read is logged and left out.

    JSON exports are lines, or one array; there a row without ``pos`` gets its place, and ``name`` and ``date_added`` stand in for title
    and time. Each export counts its positions from 0, so those of the n-th are moved up by n times 2^40 and are unique in the union.
    """
    parts = []
    for n, (name, path) in enumerate(paths.items()):
        try:
            part = _read(spark, path).withColumn("source", F.lit(name))
            parts.append(part.withColumn("pos", F.col("pos") + F.lit(n << EXPORT_BITS)))
        except PySparkException as error:
            log.warning("bookmarks of %s left out: %s", name, error)
    if not parts:
        return spark.createDataFrame([], RAW_BOOKMARK)
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part, allowMissingColumns=True)
    return union


def bookmark_source_filter(df: DataFrame, source: str) -> DataFrame:
    """Bookmarks of one browser."""
    if source not in SOURCES:
        raise ValueError(f"Unsupported browser: {source}")
    return df.where(F.col("source") == source)


def _missing_columns() -> dict:
    # The exports have no value for these.
    return {name: F.lit(MISSING) for name in ("date_last_used", "guid", "id")} | {"type": F.lit("url")}


def bookmark_normalize(raw: DataFrame) -> DataFrame:
    """Raw rows to bookmarks; rows without URL or title are dropped."""
    return (
        raw.where((F.col("url") != "") & (F.col("title") != ""))
        .withColumns(_missing_columns())
        .withColumns({"date_added": F.coalesce(iso_text(F.col("ts")), F.lit(MISSING)), "name": F.col("title")})
        .drop("ts", "title")
    )


def bookmark_export_normalize(raw: DataFrame) -> DataFrame:
    """Raw rows to exported bookmarks: untitled rows stay, the date is an epoch number."""
    return (
        raw.withColumns(_missing_columns())
        .withColumns(
            {
                "date_added": F.when(F.col("ts").isNotNull(), epoch_text(F.col("ts"))).otherwise(F.lit(MISSING)),
                "name": F.coalesce(F.col("title"), F.lit("")),
                "folder": F.coalesce(F.col("folder"), F.lit("")),
            }
        )
        .drop("ts", "title")
    )


def bookmarks_json_sink(df: DataFrame, path: str) -> None:
    """Write bookmarks as JSON lines."""
    df.write.mode("overwrite").json(path)
