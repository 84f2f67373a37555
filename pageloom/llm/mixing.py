"""Mixing sources to target weights by entropy balancing.

Every source gets a target number of words. Among all rates that give it, and that take no document more than ``cap`` times,
those closest to 1 in relative entropy are min(cap, exp(lambda * size)): an exponential tilt of each document by its size, with one
multiplier per source. The multipliers solve a convex dual, found by Newton steps that
need two sums per source. Rates depend on source and size only, so the steps run over the table of (source, size) counts. The rates are then
rounded into whole copies so that each source stays near its target.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import join_classes, n_words_of
from pageloom.operators.sizing import holds_at_most
from pageloom.session import staged

#: What sources weigh, in the order of their names, over and over.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
#: Documents of one (source, size) that one window task ranks, about.
RANK_ROWS = 50_000
#: Classes of (source, size) that are broadcast: under 100 bytes each.
BROADCAST_CLASSES = 200_000


def source_targets(classes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size, target) from ``classes(source, size, n)``.

    Sources take ``weights`` in turn, ordered by code point, NULL last, and divide ``share`` of all words; a target stops at ``cap``
    times its source and the excess goes to the others by weight. So target = min(cap * source_size, weight * level), where
    the level follows from the sources that are full: those with the smallest ratio of size to weight. There is one row per source here.
    """
    per = classes.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).cast("long").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, map(float, weights))), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    per = per.select("source", "source_size", weight.alias("weight")).withColumn("limit", cap * F.col("source_size"))
    up = Window.orderBy((F.col("limit") / F.col("weight")), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    per = per.withColumns(
        {
            "pot": share * F.sum("source_size").over(whole),
            "full": F.coalesce(F.sum("limit").over(up), F.lit(0.0)),
            "open": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0.0)),
        }
    ).withColumn("level", (F.col("pot") - F.col("full")) / F.col("open"))
    # In that order all sources are full up to the first whose limit lies above its share of what is left.
    ratio = F.col("limit") / F.col("weight")
    per = per.withColumn("final", F.min(F.when(F.col("level") < ratio, F.struct(ratio.alias("ratio"), "level"))).over(whole)["level"])
    return per.select("source", "source_size", F.least("limit", F.coalesce(F.col("weight") * F.col("final"), F.col("limit"))).alias("target"))


def _rate(tilt: Column, size: Column, cap: float) -> Column:
    return F.least(F.lit(cap), F.exp(F.least(F.lit(50.0), tilt * size)))


def solve_tilts(classes: DataFrame, targets: DataFrame, cap: float = CAP, rounds: int = 60, tolerance: float = 1e-6) -> DataFrame:
    """(source, target, scale, tilt): the multipliers, by distributed Newton steps kept inside a bracket.

    A step takes from each source the words its rates give (the gradient of the dual) and their
    derivative by the tilt. Where Newton leaves the interval known to hold the solution, the interval is halved. A source with a target
    of ``cap`` times its size needs an infinite tilt and gets the bound of the bracket.
    """
    sizes = classes.where("size > 0").groupBy("source").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("scale"), F.min("size").alias("least"))
    # exp(tilt * least / scale) = cap fills every document; below, -745 empties doubles.
    state = targets.join(sizes.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select(
        "source", "target", "scale", F.lit(0.0).alias("tilt"), (-745.0 * F.col("scale") / F.col("least")).alias("low"), (F.log(F.lit(cap)) * F.col("scale") / F.col("least")).alias("high")
    )
    state = staged(state, "tilts")
    rows = classes.where("size > 0")
    for _ in range(rounds):
        step = rows.join(state.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("tilt"), x, cap)
        words = F.col("n") * F.col("size") * rate
        sums = step.groupBy("source", "target", "scale", "tilt", "low", "high").agg(F.sum(words).alias("got"), F.sum(F.when(rate < cap, words * x).otherwise(0.0)).alias("slope"))
        gap = F.col("got") - F.col("target")
        done = (F.abs(gap) <= tolerance * F.col("target")) | (F.col("high") - F.col("low") < 1e-12)
        bounds = sums.withColumns({"done": done, "low": F.when(gap < 0, F.col("tilt")).otherwise(F.col("low")), "high": F.when(gap > 0, F.col("tilt")).otherwise(F.col("high"))})
        newton = F.col("tilt") - gap / F.col("slope")
        inside = (F.col("slope") > 0) & (newton > F.col("low")) & (newton < F.col("high"))
        move = F.when(F.col("done"), F.col("tilt")).when(inside, newton).otherwise((F.col("low") + F.col("high")) / 2)
        state = staged(bounds.select("source", "target", "scale", move.alias("tilt"), "low", "high", "done"), "tilts")
        if not state.where("NOT done").take(1):
            break
        state = state.drop("done")
    return state.select("source", "target", "scale", "tilt")


def class_copies(classes: DataFrame, tilts: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, size, n, least, extra): each document of a class is taken ``least`` times, ``extra`` of them once more.

    Classes of a source are rounded from the largest size to the smallest, each making up for the error so far. A source has few
    classes against its documents: sizes differ, so k classes hold at least k * (k + 1) / 2 words.
    """

    def round_source(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        size, n = pdf["size"].to_numpy(float), pdf["n"].to_numpy(float)
        rate = np.minimum(cap, np.exp(np.minimum(50.0, pdf["tilt"].to_numpy(float) * size / pdf["scale"].to_numpy(float))))
        low = np.floor(rate + 1e-9)
        total = np.empty(len(pdf))
        owed = 0.0
        for k in range(len(pdf)):
            owed += size[k] * n[k] * rate[k]
            top = low[k] if rate[k] - low[k] < 1e-9 else low[k] + 1
            total[k] = min(max(np.floor(owed / size[k] + 0.5), n[k] * low[k]), n[k] * min(top, np.floor(cap)))
            owed -= total[k] * size[k]
        pdf["least"] = low.astype("int64")
        pdf["extra"] = (total - n * low).astype("int64")
        return pdf[["source", "size", "n", "least", "extra"]]

    named = classes.where("size > 0").join(tilts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).select("source", "size", "n", "scale", "tilt")
    return named.groupBy("source").applyInPandas(round_source, "source string, size long, n long, least long, extra long")


def _sized(docs: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, source, size, text_key), class copies (source, size, n, least, extra) and targets of ``docs``."""
    sized = staged(docs.select("doc_id", F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"), F.xxhash64("text").alias("text_key")), "sizes")
    classes = staged(sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "size-classes")
    targets = staged(source_targets(classes, weights, share, cap), "targets")
    copies = class_copies(classes, solve_tilts(classes, targets, cap), cap)
    zero = F.lit(0).cast("long")
    return sized, copies.union(classes.where("size = 0").select("source", "size", "n", zero.alias("least"), zero.alias("extra"))), targets


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(doc_id, size, source, source_size, target, copies) for each row of ``docs(doc_id, text, source)``.

    ``size`` is the number of words of the whole text, 0 for NULL. ``copies`` is 0 to ``cap``; texts without words get no copy, and which
    documents of equal source and size are taken once more follows from the hash of doc_id, so reruns agree. Rows that
    repeat are documents of their own; where their ids are equal too, which of them is taken more often is not defined, but their number is. NULL is a source
    like any other. A source whose texts hold no words has the target 0. An empty table gives an empty result.
    """
    sized, copies, targets = _sized(docs, weights, share, cap)
    sized = sized.drop("text_key")
    # A class is ranked in parts, as many as its rows need, so no task ranks a whole hot class. It brings along what holds for its source.
    per_class = copies.withColumn("parts", F.ceil(F.col("n") / RANK_ROWS).cast("int"))
    per_class = per_class.join(targets.withColumnRenamed("source", "t"), F.col("source").eqNullSafe(F.col("t"))).drop("t")
    joined = join_classes(sized, staged(per_class, "class-copies"), ["source", "size"])
    joined = staged(joined.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts"))).drop("n", "parts"), "class-rows")
    needy = joined.where("extra > 0")
    counts = needy.groupBy("source", "size", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("source").alias("o_source"), F.col("size").alias("o_size"), F.col("part").alias("o_part"), F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    rank = Window.partitionBy("source", "size", "part").orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id")
    ranked = needy.withColumn("rank", F.row_number().over(rank)).join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("size") == F.col("o_size")) & (F.col("part") == F.col("o_part")))
    once_more = F.when(F.col("offset") + F.col("rank") <= F.col("extra"), 1).otherwise(0)
    out = ["doc_id", "size", "source", "source_size", "target"]
    more = ranked.select(*out, (F.col("least") + once_more).alias("copies"))
    return more.union(joined.where("extra <= 0").select(*out, F.col("least").alias("copies")))


def mixed_rows(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """The rows of ``docs(doc_id, text, source, ...)`` as often as the mix takes them, with all their columns.

    Sources, sizes and copies are those of ``mix``. Texts stay where they are: a class of equal source and size gets the place of the last row that is
    taken once more, in the order of a hash of doc_id and text, and every row compares itself with it. Only rows that stand at this place several
    times (equal doc_id and text) are grouped, copies meeting before the shuffle, and counted out. NULL ids and NULL sources are values like any other,
    texts without words get no copy, an empty table gives an empty one.
    """
    sized, copies, _ = _sized(docs, weights, share, cap)
    classes = staged(copies.withColumn("parts", F.ceil(F.col("n") / RANK_ROWS).cast("int")), "class-copies")
    # The order of ``mix``: by part, hash, id; rows with one id follow the hash of their text, equal rows count together.
    part, place = F.pmod(F.xxhash64("doc_id"), F.col("parts")), F.struct(F.xxhash64(F.lit(1), "doc_id").alias("h"), "doc_id", "text_key")
    needy = join_classes(sized, classes, ["source", "size"]).where("extra > 0")
    places = staged(needy.groupBy("source", "size", "extra", part.alias("part"), place.alias("place")).agg(F.count(F.lit(1)).alias("m")), "places")
    earlier = Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = places.groupBy("source", "size", "part").agg(F.sum("m").alias("rows"))
    counts = counts.select(F.col("source").alias("o_source"), F.col("size").alias("o_size"), F.col("part").alias("o_part"), "rows", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    # Only the part in which the count is reached has to be put in order.
    same_part = F.col("source").eqNullSafe(F.col("o_source")) & (F.col("size") == F.col("o_size")) & (F.col("part") == F.col("o_part"))
    reached = places.join(counts, same_part).where("offset < extra AND extra <= offset + rows")
    upto = F.col("offset") + F.sum("m").over(Window.partitionBy("source", "size").orderBy("place").rowsBetween(Window.unboundedPreceding, 0))
    last = reached.withColumn("upto", upto).where("upto >= extra AND upto - m < extra")
    last = last.select(F.col("source").alias("c_source"), F.col("size").alias("c_size"), F.struct("part", "place").alias("last"), "m", (F.col("extra") - F.col("upto") + F.col("m")).alias("of_last"))
    named = classes.join(last, F.col("source").eqNullSafe(F.col("c_source")) & (F.col("size") == F.col("c_size")), "left")
    named = staged(named.select("source", "size", "n", F.struct("least", "parts", "last", "m", "of_last").alias("class")), "mix-classes")
    rows = docs.select(F.struct("*").alias("row"), F.col("source").cast("string").alias("source"), n_words_of(F.col("text")).alias("size"))
    joined = _on_classes(rows, named).select("row", "class", F.xxhash64("row.text").alias("text_key"))
    mine = F.struct(F.pmod(F.xxhash64("row.doc_id"), F.col("class.parts")).alias("part"), F.struct(F.xxhash64(F.lit(1), "row.doc_id").alias("h"), F.col("row.doc_id"), "text_key").alias("place"))
    judged = joined.select("row", "class", F.coalesce(mine <= F.col("class.last"), F.lit(False)).alias("more"), F.coalesce((mine == F.col("class.last")) & F.col("class.last").isNotNull() & (F.col("class.m") > F.col("class.of_last")), F.lit(False)).alias("tied"))
    alone = judged.where("NOT tied").select("row", (F.col("class.least") + F.col("more").cast("int")).alias("times"))
    # Equal in id and text, perhaps not in other columns: those that sort first are taken once more.
    tied = judged.where("tied").groupBy("row", "class").agg(F.count(F.lit(1)).alias("m"))
    before = F.coalesce(F.sum("m").over(Window.partitionBy("class").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counted = tied.select("row", (F.col("class.least") * F.col("m") + F.greatest(F.lit(0), F.least(F.col("m"), F.col("class.of_last") - before))).alias("times"))
    taken = alone.unionByName(counted).where("times > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times").cast("long")))).select("row.*")


def _on_classes(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """``rows(row, source, size)`` with ``class``: broadcast while the classes are counted as few, else frequent ones are, and only the rows of others are shuffled."""
    if holds_at_most(classes, BROADCAST_CLASSES):
        named = classes.withColumnsRenamed({"source": "class_source", "size": "class_size"})
        return rows.join(F.broadcast(named), F.col("source").eqNullSafe(F.col("class_source")) & (F.col("size") == F.col("class_size")))
    return join_classes(rows, classes, ["source", "size"])
