"""Bloom filters of store segments: which of them can hold a hash, without opening them.

A filter is a set of bits, kept as rows of 64: ``(segment, kind, bits, word, mask)``, where ``kind`` is the column whose hashes are in it and
2 ^ ``bits`` the number of bits, so a filter of any size is written and read by many tasks. It takes 32 to 64 bits for a row of the
segment and 8 places for a hash: a hash that is not there passes in less than one of 100,000 cases.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.operators.sizing import BROADCAST_ROWS, pinned, small_side

#: Columns of the store with a filter.
KINDS = ("url_hash", "content_hash")
#: A batch of more hashes is not looked up: it would find something in nearly every segment.
LOOKED_UP = 5_000
BITS_PER_ROW = 32
#: So many folders of filters of like size become one.
FANOUT = 8
PLACES = 8
_DDL = "segment STRING, kind STRING, bits INT, word BIGINT, mask BIGINT"


def bits_for(rows: int) -> int:
    """The size of a filter, as a power of two: one word at least."""
    return max(6, math.ceil(math.log2(max(rows, 1) * BITS_PER_ROW)))


def _places(value: Column, bits: Column) -> Column:
    """Places of a hash among 2 ^ ``bits``, each once."""
    size = F.call_function("shiftleft", F.lit(1).cast("bigint"), bits)
    return F.array_distinct(F.array(*[F.xxhash64(value, F.lit(i)).bitwiseAND(size - 1) for i in range(PLACES)]))


def filters_write(rows: DataFrame, target: str) -> None:
    """Write the filters of ``rows(segment, bits, url_hash, content_hash)``; a hash that is NULL is in none."""
    # A place in a word, a bit; a task brings the bits of its rows together before they are moved.
    hashes = F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(k).alias("hash")) for k in KINDS])).alias("h")
    spots = (
        rows.select("segment", "bits", hashes)
        .where("h.hash IS NOT NULL")
        .select("segment", "h.kind", "bits", F.explode(_places(F.col("h.hash"), F.col("bits"))).alias("spot"))
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("spot").bitwiseAND(F.lit(63)).cast("int"))
    words = spots.groupBy("segment", "kind", "bits", F.shiftright("spot", 6).alias("word")).agg(F.bit_or(bit).alias("mask"))
    words.sortWithinPartitions("kind", "segment", "word").write.mode("overwrite").parquet(target)


def filters_merge(spark: SparkSession, paths: list[str], target: str) -> None:
    """Write the filters of several folders as one."""
    words = spark.read.schema(_DDL).parquet(*paths).hint("rebalance")
    words.sortWithinPartitions("kind", "segment", "word").write.mode("overwrite").parquet(target)


def segments_with(spark: SparkSession, path: str, segments: list[dict], hashes: DataFrame, kind: str) -> list[dict] | None:
    """Those of ``segments`` that can hold one of the hashes in the column ``kind``, or None when there are too many hashes to look up.

    Segments without a filter always stay. The filters are read where they lie; of them only names of segments come back.
    """
    filtered = [s for s in segments if "filter" in s]
    if not filtered:
        return segments
    few = pinned(hashes.select(F.col(kind).alias("hash")).where("hash IS NOT NULL").distinct(), LOOKED_UP)
    if few is None:
        return None
    wanted, found = few
    if not found:
        return [s for s in segments if "filter" not in s]
    sizes = sorted({s["bits"] for s in filtered})
    spots = wanted.select("hash", F.explode(F.lit(sizes)).alias("bits")).select(
        F.xxhash64("hash").alias("id"), "bits", _places(F.col("hash"), F.col("bits")).alias("spots")
    )
    asked = spots.select("id", "bits", F.size("spots").alias("n"), F.explode("spots").alias("spot")).select(
        "id", "bits", "n", F.shiftright("spot", 6).alias("word"), F.col("spot").bitwiseAND(F.lit(63)).cast("int").alias("bit")
    )
    filters = spark.read.schema(_DDL).parquet(*sorted({f"{path}/{s['filter']}" for s in filtered})).where(F.col("kind") == kind)
    asked = small_side(asked, small=len(found) * PLACES * len(sizes) <= BROADCAST_ROWS)
    held = filters.join(asked, ["bits", "word"]).where(F.call_function("shiftright", "mask", "bit").bitwiseAND(F.lit(1)) == 1)
    passed = held.groupBy("segment", "id").agg(F.count(F.lit(1)).alias("met"), F.max("n").alias("n")).where("met = n")
    names = {r[0] for r in passed.select("segment").distinct().collect()}
    return [s for s in segments if "filter" not in s or s["path"] in names]
