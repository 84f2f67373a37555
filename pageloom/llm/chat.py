"""Chat formatting after collapse of cumulative snapshots.

Logs often hold a conversation again after each turn. A rolling hash of every prefix of turns finds conversations
that are the beginning of a longer one; an anti-join leaves the maximal ones, which are rendered.

The hash of a prefix is the sum of hashes of its (place, role, text), in four lanes of 32 bits, so prefixes of a conversation of any
length come from prefix sums: parts of it are summed apart and the sums of earlier parts added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.session import staged

#: Turns of a conversation that one cell holds when rendered; longer ones are rendered in several rows.
PART_TURNS = 4096
_LANES = ("a", "b", "c", "d")
_LOW = (1 << 32) - 1


def _content(seed: int) -> Column:
    return F.xxhash64(F.lit(seed), F.col("role").isNull(), "role", F.col("text").isNull(), "text")


def _parts(turns: DataFrame) -> DataFrame:
    """The rows with ``part``: order within a conversation first by part, then by (turn, role, c1, c2). A range partition cuts long conversations."""
    ranged = turns.repartitionByRange("conv_id", F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), "c1", "c2")
    return staged(ranged.withColumn("part", F.spark_partition_id()), "turns")


def _turn_order() -> list[Column]:
    return [F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("c1"), F.col("c2")]


def turn_prefixes(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, a, b, c, d): the rolling hash of each conversation's first ``place`` turns."""
    narrow = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), _content(1).alias("c1"), _content(2).alias("c2"))
    turns = _parts(narrow)
    inside = Window.partitionBy("conv_id", "part").orderBy(*_turn_order()).rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = turns.groupBy("conv_id", "part").agg(F.count(F.lit(1)).alias("n"))
    before = before.select(F.col("conv_id").alias("k"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"))
    same = F.col("conv_id").eqNullSafe(F.col("k")) & (F.col("part") == F.col("p"))
    placed = turns.withColumn("row", F.count(F.lit(1)).over(inside)).join(before, same).withColumn("place", F.col("n0") + F.col("row")).drop("k", "p", "n0", "row")
    e1, e2 = F.xxhash64("place", "c1", "c2"), F.xxhash64("c2", "place", "c1")
    lanes = {"a": e1.bitwiseAND(_LOW), "b": F.shiftrightunsigned(e1, 32), "c": e2.bitwiseAND(_LOW), "d": F.shiftrightunsigned(e2, 32)}
    placed = staged(placed.select("conv_id", "part", "place", *(v.alias(k) for k, v in lanes.items())), "places")
    sums = placed.groupBy("conv_id", "part").agg(*(F.sum(x).alias(x) for x in _LANES))
    sums = sums.select(F.col("conv_id").alias("k"), F.col("part").alias("p"), *(F.coalesce(F.sum(x).over(earlier), F.lit(0)).alias(f"{x}0") for x in _LANES))
    running = Window.partitionBy("conv_id", "part").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    rows = placed.select("conv_id", "part", "place", *(F.sum(x).over(running).alias(x) for x in _LANES)).join(sums, same)
    return rows.select("conv_id", "place", *((F.col(x) + F.col(f"{x}0")).alias(x) for x in _LANES))


def maximal_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns) of the conversations that begin no longer one; of equal conversations the smallest conv_id (NULL last).

    Turns are ordered by ``turn`` (NULL first, ties by role, then by a hash of the text); turn numbers themselves don't matter. NULL differs from the empty text. Rows
    without conv_id are one conversation. Prefixes and conversations are made distinct before they meet, so a first turn or a
    conversation that a third of the table shares is one row.
    """
    prefixes = staged(turn_prefixes(conversations), "prefixes")
    whole = prefixes.groupBy("conv_id").agg(F.max(F.struct("place", *_LANES)).alias("h")).select("conv_id", "h.*")
    distinct = whole.groupBy("place", *_LANES).agg(F.min(F.struct(F.col("conv_id").isNull().alias("none"), "conv_id")).alias("first"))
    sizes = whole.select(F.col("conv_id").alias("k"), F.col("place").alias("n"))
    # Longer prefixes of the same conversation are what a shorter one is compared with.
    inner = prefixes.join(sizes, F.col("conv_id").eqNullSafe(F.col("k"))).where("place < n").select("place", *_LANES).distinct()
    return distinct.join(inner, ["place", *_LANES], "left_anti").select("first.conv_id", F.col("place").alias("n_turns"))


def render_turn(role: Column, text: Column) -> Column:
    """A turn in chat markup; markers inside a text or role are broken by a blank. NULL roles are ``unknown``, NULL texts empty."""
    plain = lambda c, default: F.replace(F.coalesce(c, F.lit(default)), F.lit("<|"), F.lit("< |"))
    return F.concat(F.lit("<|im_start|>"), plain(role, "unknown"), F.lit("\n"), plain(text, ""), F.lit("<|im_end|>\n"))


def format_chats(conversations: DataFrame, part_turns: int = PART_TURNS) -> DataFrame:
    """(conv_id, n_turns, part, text): the maximal conversations of ``conversations(conv_id, turn, role, text)``, rendered.

    Conversations of up to ``part_turns`` turns are one row with part 0. Longer ones have parts, in order, whose texts joined
    give the whole. An empty table gives an empty result; other columns are ignored.
    """
    keep = staged(maximal_conversations(conversations), "maximal").withColumnRenamed("conv_id", "k")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), "text", _content(1).alias("c1"), _content(2).alias("c2"))
    rows = rows.join(keep, F.col("conv_id").eqNullSafe(F.col("k"))).drop("k")
    entry = F.struct("turn", "role", "c1", "c2", render_turn(F.col("role"), F.col("text")).alias("piece"))

    def joined(df: DataFrame) -> DataFrame:
        parts = df.groupBy("conv_id", "n_turns", "part").agg(F.array_sort(F.collect_list(entry)).alias("turns"))
        return parts.select("conv_id", "n_turns", "part", F.array_join("turns.piece", "").alias("text"))

    short = joined(rows.where(F.col("n_turns") <= part_turns).withColumn("part", F.lit(0)))
    if not keep.where(F.col("n_turns") > part_turns).take(1):
        return short
    long = _parts(rows.where(F.col("n_turns") > part_turns))
    return short.unionByName(joined(long))
