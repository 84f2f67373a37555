"""Failure records."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from pageloom.operators.numbering import number_rows
from pageloom.schema import FAILURE
from pageloom.sources import fs

_KEYED = T.StructType([T.StructField("key", T.LongType()), *FAILURE.fields])


def _segments(spark: SparkSession, path: str) -> list[str]:
    return [s for s in fs.subfolders(spark, path) if s.startswith("seg=") and fs.exists(spark, f"{path}/{s}/_SUCCESS")]


def _read(spark: SparkSession, path: str, segments: list[str]) -> DataFrame:
    return spark.read.schema(_KEYED).parquet(*[f"{path}/{s}" for s in segments]) if segments else spark.createDataFrame([], _KEYED)


def failed_append(failed: DataFrame, path: str, segment: str | None = None) -> None:
    """Append failure records, numbered on from the largest key that is there, in order of position.

    A run that names its ``segment`` and starts again writes its records in place of those of the first attempt.
    """
    spark = failed.sparkSession
    name = f"seg={segment if segment is not None else uuid.uuid4().hex}"
    others = _read(spark, path, [s for s in _segments(spark, path) if s != name])
    last = others.agg(F.max("key")).first()[0]
    rows = failed.select(*[F.col(f.name).cast(f.dataType) for f in FAILURE.fields])
    keyed = number_rows(rows, "pos", "key").withColumn("key", F.col("key") + (last or 0))
    keyed.select(*_KEYED.names).write.mode("overwrite").parquet(f"{path}/{name}")


def failed_scan(spark: SparkSession, path: str, keyed: bool = False) -> DataFrame:
    """Failure records, with their lasting keys on demand."""
    return _read(spark, path, _segments(spark, path)).select(*(_KEYED if keyed else FAILURE).names)


def failed_urls_sink(failed: DataFrame, path: str) -> None:
    """Write failure records as JSON lines."""
    failed.select("url", "title", "reason", "timestamp").write.mode("overwrite").json(path)
