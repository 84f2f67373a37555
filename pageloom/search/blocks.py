"""Which blocks of documents a search has to read.

A block is a run of documents with consecutive keys, the same for all terms. For each term and block the index keeps how often each term frequency
occurs and the shortest and longest field among those documents; with the corpus sizes of today that gives what the block can score at
most, exactly, and how many of its documents score at least so much.

A query of several words needs only blocks in which each of them occurs. A query of one word knows its number of results from the vocabulary, so it
needs only blocks that can reach the score of the last row of its page: the bounds give a score that enough documents reach, and blocks whose
maximum lies below it are not read. Rows at that score stay, so ties are decided as by full scoring.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.operators.sizing import small_side
from pageloom.search.index import Index
from pageloom.search.match import Footprint, within
from pageloom.search.rank import B, K1, SCORE_DIGITS, term_score

PLACE = ["field", "term", "seg", "block"]
# Scores are counted in steps of one over this, so a query has some thousand steps at most, however many blocks its word has.
STEPS = 256


def _rounded(score: Column) -> Column:
    return F.round(score, SCORE_DIGITS)


def impact_hits(index: Index, expanded: DataFrame, touched: Footprint, k1: float = K1, b: float = B) -> DataFrame:
    """Expanded terms with the blocks they occur in, and per term frequency there ``n`` documents that score from ``low`` to ``high``."""
    impacts = within(index.impacts, touched).select(*PLACE, "tf", "n", "min_dl", "max_dl")
    rows = impacts.join(small_side(expanded, small=touched.small), ["field", "term"]).join(F.broadcast(index.corpus), "field")
    high = _rounded(term_score(k1, b, F.col("min_dl")))
    low = _rounded(term_score(k1, b, F.col("max_dl")))
    return rows.withColumns({"high": high, "low": low}).drop("tf", "min_dl", "max_dl", "n_docs", "avg_len")


def _step(score: Column) -> Column:
    return F.floor(score * STEPS)


def reached_scores(hits: DataFrame, depths: DataFrame) -> DataFrame:
    """(query_id, reached): a score that at least ``depth`` documents of each query of ``depths(query_id, depth)`` have; none where there are fewer.

    Documents are counted by step of their least score before anything is put in order, so a word that is everywhere costs a row per step.
    """
    steps = hits.groupBy("query_id", _step(F.col("low")).alias("step")).agg(F.sum("n").alias("n"))
    above = Window.partitionBy("query_id").orderBy(F.desc("step"))
    counted = steps.withColumn("have", F.sum("n").over(above)).join(small_side(depths), "query_id")
    # Documents of a step score at least its lower edge.
    return counted.where("have >= depth").groupBy("query_id").agg((F.max("step") / STEPS).alias("reached"))


def best_blocks(hits: DataFrame, depths: DataFrame) -> DataFrame:
    """The blocks of one-word queries that can hold one of the first ``depth`` rows: ``(query_id, field, term, seg, block)``."""
    tops = hits.groupBy("query_id", *PLACE).agg(F.max("high").alias("high"))
    limited = tops.join(small_side(reached_scores(hits, depths)), "query_id", "left")
    return limited.where(F.col("reached").isNull() | (F.col("high") >= F.col("reached"))).select("query_id", *PLACE)


def shared_blocks(hits: DataFrame) -> DataFrame:
    """The blocks in which every word of a query occurs, in some expansion: ``(query_id, field, term, seg, block)``."""
    places = hits.select("query_id", "n_terms", "ord", *PLACE).distinct()
    full = places.groupBy("query_id", "n_terms", "seg", "block").agg(F.countDistinct("ord").alias("found")).where("found = n_terms")
    return places.join(full.select("query_id", "seg", "block"), ["query_id", "seg", "block"], "left_semi").select("query_id", *PLACE).distinct()


def postings_in(index: Index, expanded: DataFrame, blocks: DataFrame, touched: Footprint) -> DataFrame:
    """Postings of expanded terms in their blocks; like ``postings_join`` of all blocks, but for the rows of blocks left out.

    A term, segment and block hold a bounded number of postings, so no key of the join is hot but by the number of queries that share a term.
    """
    wanted = blocks.join(small_side(expanded, small=touched.small), ["query_id", "field", "term"])
    filed = within(index.postings, touched).select(*PLACE, "key", "tf", "dl")
    return filed.join(small_side(wanted), PLACE).drop("seg", "block")
