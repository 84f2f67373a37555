"""Shards of near equal bytes by sampled splitters, in DataFrame functions only.

Records are ordered by (hash of the text, doc_id), so equal texts are neighbours. A size-weighted sample of keys gives
quantiles, which cut the order into ranges, many for each shard; ranges that turn out overfull are cut again by a denser sample of
their own. Exact byte counts of the ranges and running sums inside them give each record its place among all bytes, and shards
end at equal shares of these.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import join_classes
from pageloom.session import staged

SHARDS = 24
RANGES_PER_SHARD = 16
#: Rows that a range holds, about, and keys sampled for each range.
RANGE_ROWS = 100_000
SAMPLE_PER_RANGE = 64
MAX_RANGES = 1 << 14
#: A range is overfull beyond this multiple of its share.
OVERFULL = 1.5
#: Share of a shard's bytes up to which the copies of a text stay together.
GROUP_SHARE = 0.05

_KEY = ("text_key", "doc_id")


def _key() -> Column:
    return F.struct(F.col("text_key").alias("k"), F.col("doc_id").alias("d"))


def _sampled(records: DataFrame, per_byte: Column, seed: int) -> DataFrame:
    """Keys drawn with a probability in proportion to their size, the same ones at every run."""
    chance = F.shiftrightunsigned(F.xxhash64(F.lit(seed), *_KEY), 11) / float(1 << 53)
    return records.where(chance < F.col("size") * per_byte)


def _splitters(sample: DataFrame, ranges: int) -> list:
    """At most ``ranges - 1`` keys that cut the sample into equal parts."""
    place = F.row_number().over(Window.orderBy(_key().asc())) - 1
    cut = sample.select(_key().alias("key"), F.floor(place * ranges / F.count(F.lit(1)).over(Window.partitionBy())).alias("part"))
    return [(r["key"]["k"], r["key"]["d"]) for r in cut.groupBy("part").agg(F.min("key").alias("key")).where("part > 0").orderBy("part").collect()]


def _range_of(splitters: list) -> Column:
    """The number of splitters at or below a record's key, found in two steps: a block of splitters, then the splitter inside it."""
    if not splitters:
        return F.lit(0)
    width = max(1, round(len(splitters) ** 0.5))
    blocks = [splitters[k : k + width] for k in range(0, len(splitters), width)]
    kind = "array<array<struct<k:bigint,d:bigint>>>"
    text = "[" + ",".join("[" + ",".join(f'{{"k":{k},"d":{"null" if d is None else d}}}' for k, d in block) + "]" for block in blocks) + "]"
    table = F.from_json(F.lit(text), kind)
    below = lambda keys: F.size(F.filter(keys, lambda s: s <= _key()))
    block = below(F.transform(table, lambda b: F.get(b, 0)))
    return F.when(block == 0, 0).otherwise((block - 1) * width + below(F.get(table, block - 1)))


def _ranged(records: DataFrame, shards: int) -> DataFrame:
    """The records with ``range``, numbered in the order of keys."""
    rows, total = records.agg(F.count(F.lit(1)), F.sum("size")).first()
    if not rows:
        return records.withColumn("range", F.lit(0))
    ranges = min(MAX_RANGES, max(shards * RANGES_PER_SHARD, -(-rows // RANGE_ROWS)))
    splitters = _splitters(_sampled(records, F.lit(ranges * SAMPLE_PER_RANGE / total), 1), ranges)
    first = records.withColumn("range", _range_of(splitters))
    share = total / ranges
    overfull = first.groupBy("range").agg(F.sum("size").alias("bytes")).where(F.col("bytes") > OVERFULL * share)
    again = [(r["range"], r["bytes"]) for r in overfull.collect()]
    if not again:
        return first
    # One denser sample for all overfull ranges; each gets as many splitters as it holds shares.
    inside = first.where(F.col("range").isin([r for r, _ in again]))
    sample = staged(_sampled(inside, F.lit(8 * ranges * SAMPLE_PER_RANGE / total), 2).select("range", *_KEY), "range-sample")
    by_range = Window.partitionBy("range").orderBy(_key().asc())
    parts = F.ceil(F.count(F.lit(1)).over(Window.partitionBy("range")) / (8 * SAMPLE_PER_RANGE))
    cut = sample.select("range", _key().alias("key"), F.floor((F.row_number().over(by_range) - 1) * parts / F.count(F.lit(1)).over(Window.partitionBy("range"))).alias("part"))
    more = [(r["key"]["k"], r["key"]["d"]) for r in cut.groupBy("range", "part").agg(F.min("key").alias("key")).where("part > 0").collect()]
    order = lambda s: (s[0], s[1] is not None, s[1] or 0)  # noqa: E731  as Spark orders them: NULL first
    return records.withColumn("range", _range_of(sorted({*splitters, *more}, key=order)))


def assign_shards(docs: DataFrame, shards: int = SHARDS, group_share: float = GROUP_SHARE) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) for each row of ``docs(doc_id, text)``.

    ``size``: UTF-8 bytes of the text (NULL: none) plus 8. Shards 0 to ``shards - 1`` have near equal bytes; ``slot`` counts from 0 in
    each without gaps. Copies of a text are in one shard, unless they have more than ``group_share`` of a shard's bytes: such groups are cut
    where a shard is full. A row larger than a shard fills one alone and may leave a neighbour empty. NULL and
    empty texts are texts of their own; their crc32 is 0. Ties of text and id, as in rows that repeat, are numbered in any order. Other columns
    are ignored. An empty table gives an empty result.
    """
    text = F.col("text")
    records = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 8).cast("long").alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.xxhash64(text.isNull(), text).alias("text_key"),
    )
    records = staged(records, "records")
    ranged = staged(_ranged(records, shards), "ranged")
    per_range = ranged.groupBy("range").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    # One row for each range, of which there is a fixed number at most.
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("range", F.coalesce(F.sum("bytes").over(earlier), F.lit(0)).alias("byte_0"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row_0"), F.sum("bytes").over(Window.partitionBy()).alias("total"))
    within = Window.partitionBy("range").orderBy(*_KEY, "size").rowsBetween(Window.unboundedPreceding, 0)
    placed = ranged.withColumns({"upto": F.sum("size").over(within), "nth": F.count(F.lit(1)).over(within)}).join(F.broadcast(offsets), "range")
    placed = placed.select("doc_id", "size", "text_crc32", "text_key", "total", (F.col("byte_0") + F.col("upto")).alias("stop"), (F.col("row_0") + F.col("nth") - 1).alias("row"))
    placed = staged(placed, "places")
    # The copies of a text lie side by side: all go where their middle byte goes.
    groups = placed.groupBy("text_key").agg(F.count(F.lit(1)).alias("copies"), F.sum("size").alias("group_bytes"), F.max("stop").alias("group_stop"), F.max("total").alias("group_total"))
    together = (F.col("copies") > 1) & (F.col("group_bytes") * shards <= group_share * F.col("group_total"))
    groups = groups.select("text_key", "copies", F.when(together, F.col("group_bytes")).alias("group_bytes"), F.when(together, F.col("group_stop")).alias("group_stop"))
    whole = join_classes(placed, staged(groups, "groups"), ["text_key"], "copies")
    middle = F.coalesce(F.col("group_stop") - F.col("group_bytes") / 2, F.col("stop") - F.col("size") / 2)
    whole = whole.withColumn("shard", F.least(F.floor(middle * shards / F.col("total")), F.lit(shards - 1)).cast("int"))
    whole = staged(whole.select("doc_id", "size", "text_crc32", "shard", "row"), "shards")
    starts = whole.groupBy("shard").agg(F.min("row").alias("start"))
    return whole.join(F.broadcast(starts), "shard").select("doc_id", "size", "text_crc32", "shard", (F.col("row") - F.col("start")).alias("slot"))
