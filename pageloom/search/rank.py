"""Scores, totals and pages."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.functions.text import is_blank
from pageloom.operators.sizing import small_side
from pageloom.search.index import Index
from pageloom.session import durable

# Fixed values of the ranking formula, the score of a fuzzy term, page limits.
K1, B = 1.2, 0.75
FUZZY_SCORE = 1.0
DEFAULT_PAGE_SIZE, MAX_PAGE_SIZE = 20, 100
# Scores are rounded, so the order of ties does not hang on the order of additions.
SCORE_DIGITS = 6
# Deepest row that is found by keeping the best rows of every task.
SHALLOW_ROWS = 1000


def term_score(k1: float, b: float, dl: Column | None = None) -> Column:
    """BM25 of a term, from ``tf, df, n_docs, avg_len`` and a field of length ``dl``. It falls with the length and grows with ``tf``."""
    idf = F.log(F.col("n_docs") / (F.col("df") + 1)) + 1
    norm = F.col("tf") + k1 * (1 - b + b * (F.col("dl") if dl is None else dl) / F.col("avg_len"))
    return idf * F.col("tf") * (k1 + 1) / norm


def scored_hits(hits: DataFrame, index: Index, k1: float = K1, b: float = B, fuzzy_score: float | None = FUZZY_SCORE):
    """Hits with the ``part`` they add to a score.

    A fuzzy term scores a constant, or like any term with ``fuzzy_score=None``.
    The corpus table has a row per field, so it is always small.
    """
    by_term = hits.join(F.broadcast(index.corpus), "field")
    part = term_score(k1, b)
    if fuzzy_score is not None:
        part = F.when(F.col("fuzzy"), F.lit(fuzzy_score)).otherwise(part)
    return by_term.withColumn("part", part)


def bm25_score(
    hits: DataFrame, index: Index, k1: float = K1, b: float = B, fuzzy_score: float | None = FUZZY_SCORE
) -> DataFrame:
    """Scores of the documents that have every term of their query: ``(query_id, key, score)``.

    A fuzzy term counts once per document, with its best expansion.
    """
    return _summed(scored_hits(hits, index, k1, b, fuzzy_score).select("query_id", "key", "n_terms", "ord", "part").repartition("query_id", "key"))


def bm25_scores(
    alone: DataFrame | None, others: DataFrame | None, index: Index, k1: float = K1, b: float = B, fuzzy_score: float | None = FUZZY_SCORE
) -> DataFrame:
    """``bm25_score`` of both parts of ``parted_matches``: a hit of a query found alone is its score, and nothing is moved for it."""
    parts = []
    if alone is not None:
        parts.append(scored_hits(alone, index, k1, b, fuzzy_score).select("query_id", "key", F.round("part", SCORE_DIGITS).alias("score")))
    if others is not None:
        parts.append(_summed(scored_hits(others, index, k1, b, fuzzy_score)))
    return reduce(DataFrame.unionByName, parts)


def _summed(scored: DataFrame) -> DataFrame:
    """Scores from the parts of hits that are together by document."""
    return (
        scored.groupBy("query_id", "key", "n_terms", "ord")
        .agg(F.max("part").alias("part"))
        .groupBy("query_id", "key", "n_terms")
        .agg(F.count(F.lit(1)).alias("found"), F.round(F.sum("part"), SCORE_DIGITS).alias("score"))
        .where("found = n_terms")
        .select("query_id", "key", "score")
    )


def search_total_hits(found: DataFrame) -> DataFrame:
    """Matching documents per query; ``found`` has a row per match."""
    return found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total_results"))


def _clamped(requests: DataFrame) -> DataFrame:
    page = F.greatest(F.lit(1), F.coalesce(F.col("page").cast("bigint"), F.lit(1)))
    size = F.coalesce(F.col("page_size").cast("bigint"), F.lit(DEFAULT_PAGE_SIZE))
    return requests.withColumns({"page": page, "page_size": F.least(F.greatest(F.lit(1), size), F.lit(MAX_PAGE_SIZE))})


def pagination_meta(totals: DataFrame, requests: DataFrame) -> DataFrame:
    """Pages of every request: ``(query_id, page, page_size, total_results, total_pages, has_next, has_prev)``."""
    asked = _clamped(requests).select("query_id", "page", "page_size")
    total = F.coalesce("total_results", F.lit(0))
    pages = F.ceil(total / F.col("page_size"))
    return asked.join(totals, "query_id", "left").select(
        "query_id", "page", "page_size", total.alias("total_results"), pages.alias("total_pages"),
        (F.col("page") < pages).alias("has_next"), (F.col("page") > 1).alias("has_prev"),
    )


def _best_first() -> tuple[Column, Column]:
    return F.col("score").desc(), F.col("key").asc()


def wanted_rows(pagination: DataFrame) -> DataFrame:
    """First and last rank of each page; a page past the end is the last one."""
    page = F.least(F.col("page"), F.greatest(F.col("total_pages"), F.lit(1)))
    first = (page - 1) * F.col("page_size") + 1
    return pagination.select("query_id", first.alias("_first"), (first + F.col("page_size") - 1).alias("_last"))


def _ranked_by_sort(scored: DataFrame) -> DataFrame:
    """Rank of every match by one global sort.

    The sort splits a query with very many matches over tasks. Ranks are the row
    number within the task's part of the query, plus the rows of the query in
    earlier parts. The sorted rows are checkpointed, so both look at the same
    parts.
    """
    ordered = durable(
        scored.orderBy("query_id", *_best_first()).withColumns(
            {"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}
        )
    )
    earlier = Window.partitionBy("query_id").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    # A row per query and part that holds some of it.
    parts = (
        ordered.groupBy("query_id", "_part")
        .agg(F.min("_at").alias("_start"), F.count(F.lit(1)).alias("_n"))
        .withColumn("_earlier", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    )
    return (
        ordered.join(small_side(parts.select("query_id", "_part", "_start", "_earlier")), ["query_id", "_part"])
        .withColumn("rank", F.col("_earlier") + F.col("_at") - F.col("_start") + 1)
        .drop("_part", "_at", "_start", "_earlier")
    )


def search_page(
    scored: DataFrame, pagination: DataFrame, shallow_rows: int = SHALLOW_ROWS, small: bool | None = None, deepest: int | None = None
) -> DataFrame:
    """Rows of the requested page of every query with their ``rank``, best first.

    When all pages lie near the top, the limit on the row number makes every
    task keep its best rows before the shuffle, so a query that matches a third
    of all documents sends few. Deep pages are found by a global sort instead. ``deepest`` is a rank that no page passes, where the
    caller knows one.
    """
    wanted = wanted_rows(pagination)
    if deepest is None:
        deepest = wanted.agg(F.max("_last")).first()[0] or 0
    if deepest <= shallow_rows:
        per_query = Window.partitionBy("query_id").orderBy(*_best_first())
        ranked = scored.withColumn("rank", F.row_number().over(per_query)).where(F.col("rank") <= int(deepest))
    else:
        ranked = _ranked_by_sort(scored)
    return (
        ranked.join(small_side(wanted, small=small), "query_id")
        .where(F.col("rank").between(F.col("_first"), F.col("_last")))
        .select("query_id", F.col("rank").cast("bigint").alias("rank"), "key", "score")
    )


# The texts that a refused request gets.
QUERY_MISSING = "Query parameter is required"
PAGE_INVALID = "Invalid pagination parameters: page >= 1, 1 <= page_size <= 100"


def request_validate(requests: DataFrame, mode: str = "reject") -> DataFrame:
    """Check search requests ``(query_id, text, page, page_size)``, the last two as text.

    ``reject`` adds a ``status``; ``clamp`` brings page and size into range.
    """
    if mode == "clamp":
        as_number = {c: F.col(c).try_cast("bigint") for c in ("page", "page_size")}
        return _clamped(requests.withColumns(as_number))
    if mode != "reject":
        raise ValueError(f"unknown mode: {mode}")
    page = F.coalesce(F.col("page"), F.lit("1")).try_cast("bigint")
    size = F.coalesce(F.col("page_size"), F.lit(str(DEFAULT_PAGE_SIZE))).try_cast("bigint")
    valid = F.coalesce((page >= 1) & size.between(1, MAX_PAGE_SIZE), F.lit(False))
    status = (
        F.when(is_blank(F.col("text")), QUERY_MISSING)
        .when(~valid, PAGE_INVALID)
        .otherwise("ok")
    )
    return requests.withColumn("status", status)
