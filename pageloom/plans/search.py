"""Batch search: requests in, pages of results and pagination out."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from pageloom.operators.sizing import pinned, small_side
from pageloom.search.analysis import query_terms
from pageloom.search.blocks import best_blocks, impact_hits, postings_in, shared_blocks
from pageloom.search.index import Index
from pageloom.search.match import Footprint, expand_terms, parted_join, surveyed
from pageloom.search.rank import (
    bm25_score,
    bm25_scores,
    pagination_meta,
    request_validate,
    search_page,
    search_total_hits,
    wanted_rows,
)
from pageloom.search.results import search_fragments, search_result_record, search_snippet
from pageloom.session import staged


# Page rows up to this number are fetched by their keys.
PUSHED_KEYS = 1000


def search_batch(index: Index, requests: DataFrame, fragments: int = 0) -> tuple[DataFrame, DataFrame]:
    """Answer ``requests(query_id, text, page, page_size)``.

    Expansion, scores, pagination and page rows are made once each: scores are staged, the others too unless they are so few that
    they become local tables. Few page rows fetch their documents by key, so only these are read. With an index on disk only
    blocks of documents are read that a page can need. With ``fragments`` a snippet shows that many of the best places of the
    text, else the surroundings of the first hit.
    """
    valid = request_validate(requests, "clamp")
    expanded, touched = surveyed(expand_terms(index, query_terms(valid)), index.buckets, "expanded")
    if index.impacts is None:
        scored = staged(bm25_scores(*parted_join(index, expanded, touched), index), "scored")
        totals = search_total_hits(scored)
    else:
        scored, totals = needed_scores(index, expanded, touched, valid)
    pagination, asked = _settled(pagination_meta(totals, valid), "pagination")
    small = asked is not None or None
    # A page past the end becomes the last one, which lies above it.
    deepest = max((r["page"] * r["page_size"] for r in asked), default=0) if small else None
    page_rows, shown = _settled(search_page(scored, pagination, small=small, deepest=deepest), "page")
    keys = None if shown is None else sorted({r["key"] for r in shown})
    records = search_result_record(page_rows, index.docs, shown is not None or None, keys)
    marked, small_terms = expanded.select("query_id", "term"), touched.terms is not None or None
    if fragments:
        results = search_fragments(records, marked, fragments, small=small_terms)
    else:
        results = search_snippet(records, marked, small=small_terms)
    return results.drop("composite_text"), pagination


def needed_scores(index: Index, expanded: DataFrame, touched: Footprint, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Scores of all documents that a page of a request can hold, and the numbers of results of all queries.

    Blocks are chosen for few terms only; for many, choosing them would move more than it leaves unread, so their postings are scored where they lie.
    """
    alone = F.expr("n_terms = 1 AND NOT fuzzy")
    # A word without edits is one term: as many results as documents have it.
    known = expanded.where(alone).select("query_id", F.col("df").alias("total_results"))
    if touched.terms is None:
        scored = staged(bm25_scores(*parted_join(index, expanded, touched), index), "scored")
    else:
        hits = impact_hits(index, expanded, touched)
        depths = wanted_rows(pagination_meta(known, requests)).select("query_id", F.col("_last").alias("depth"))
        blocks = best_blocks(hits.where(alone), depths).unionByName(shared_blocks(hits.where(~alone)))
        scored = staged(bm25_score(postings_in(index, expanded, blocks, touched), index), "scored")
    others = scored.join(small_side(known.select("query_id")), "query_id", "left_anti")
    return scored, known.unionByName(search_total_hits(others))


def _settled(df: DataFrame, name: str) -> tuple[DataFrame, list[dict] | None]:
    """``df`` as a local table with its rows when they are few, else staged."""
    few = pinned(df, PUSHED_KEYS)
    return (staged(df, name), None) if few is None else few


def search_one(index: Index, text: str, page: int = 1, page_size: int = 20, fragments: int = 0) -> tuple[DataFrame, DataFrame]:
    """Answer a single request; results come best first."""
    spark = index.docs.sparkSession
    requests = spark.range(1).select(
        F.col("id").alias("query_id"), F.lit(text).alias("text"), F.lit(page).alias("page"),
        F.lit(page_size).alias("page_size"),
    )
    results, pagination = search_batch(index, requests, fragments)
    return results.orderBy("rank"), pagination
