"""Snippets and result records for the rows of a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.operators.sizing import BROADCAST_ROWS, holds_at_most, small_side
from pageloom.search.analysis import TOKEN
from pageloom.session import staged

SNIPPET_CHARS = 200
# Words and gaps taken on each side of the first hit.
CONTEXT_PIECES = 20
# Fragments: how many, the words and gaps that a fragment looks at from a hit on, and those shown before it.
FRAGMENTS = 3
FRAGMENT_PIECES = 24
LEAD_PIECES = 8
OPEN, CLOSE = "<b>", "</b>"

# Cuts a text into words and the gaps between them.
_PIECES = rf"{TOKEN}|[^\p{{L}}\p{{N}}_]+"


def _is_term(piece: Column) -> Column:
    return F.array_contains("_terms", F.lower(piece))


def _found_terms(page_rows: DataFrame, terms: DataFrame) -> DataFrame:
    """Per page row the terms to mark, out of those that its own text holds."""
    held = page_rows.select("query_id", "rank", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("composite_text"), F.lit(TOKEN), F.lit(0)))).alias("term"))
    return held.join(terms.distinct(), ["query_id", "term"]).groupBy("query_id", "rank").agg(F.collect_set("term").alias("_found"))


def _in_pieces(page_rows: DataFrame, terms: DataFrame, small: bool | None) -> DataFrame:
    """Page rows with their ``_pieces``, words and gaps in order, and the ``_terms`` to mark in them."""
    if small is None:
        small = holds_at_most(terms, BROADCAST_ROWS)
    if small:
        per_query = terms.groupBy("query_id").agg(F.collect_set("term").alias("_found"))
        shown = page_rows.join(F.broadcast(per_query), "query_id", "left")
    else:
        page_rows = staged(page_rows, "page-rows")
        shown = page_rows.join(_found_terms(page_rows, terms), ["query_id", "rank"], "left")
    return (
        # The rows of a page are few and their texts long: spread the work evenly.
        shown.repartition("query_id", "rank")
        .withColumn("_terms", F.coalesce("_found", F.array().cast("array<string>")))
        .withColumn("_pieces", F.regexp_extract_all("composite_text", F.lit(_PIECES), F.lit(0)))
        .drop("_found")
    )


def _marked(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: F.when(_is_term(p), F.concat(F.lit(OPEN), p, F.lit(CLOSE))).otherwise(p)), "")


def _head(text: Column) -> Column:
    return F.concat(F.left(text, F.lit(SNIPPET_CHARS)), F.lit("..."))


def search_snippet(
    page_rows: DataFrame, terms: DataFrame, context: int = CONTEXT_PIECES, small: bool | None = None
) -> DataFrame:
    """Add ``snippet`` to page rows that carry ``composite_text``.

    The snippet is the words around the first hit with the hits marked, or the
    head of the text when there is none. ``terms(query_id, term)`` are the terms
    to mark. When they are counted as few (or ``small`` says so) they travel as one array per query; else a row
    gets those of its own text, however far a query was expanded. The text is
    cut up in one step and looked at in the next ones, each value made once.
    """
    text, first = F.col("composite_text"), F.col("_first")
    begin = F.greatest(first - context, F.lit(1)).cast("int")
    return (
        _in_pieces(page_rows, terms, small)
        .withColumn("_first", F.array_position(F.transform("_pieces", _is_term), F.lit(True)))
        .withColumn(
            "_window", F.when(first > 0, F.slice("_pieces", begin, (first + context - begin + 1).cast("int")))
        )
        .withColumn("snippet", F.coalesce(_marked(F.col("_window")), _head(text)))
        .drop("_terms", "_pieces", "_first", "_window")
    )


def search_fragments(
    page_rows: DataFrame,
    terms: DataFrame,
    fragments: int = FRAGMENTS,
    width: int = FRAGMENT_PIECES,
    lead: int = LEAD_PIECES,
    small: bool | None = None,
) -> DataFrame:
    """Add ``snippet`` as ``search_snippet`` does, of the best ``fragments`` places of the text.

    A place begins at a hit and takes ``width`` words and gaps; it counts by the different terms in it, then by its hits, and the
    earlier of equals wins. A place that meets a better one, the ``lead`` shown before each included, is left out. Those that stay
    stand in the order of the text, joined by dots. A text without a hit shows its head, one that is NULL shows NULL. A place looks
    at no more than ``width`` of the hits, so the work is in proportion to the text.
    """
    numbered = F.transform("_pieces", lambda p, i: F.struct((i + 1).alias("at"), F.lower(p).alias("term")))
    places = F.transform(
        "_hits",
        lambda h, i: F.struct(
            h["at"].alias("at"),
            F.filter(F.slice("_hits", i + 1, F.lit(width)), lambda g: g["at"] < h["at"] + width)["term"].alias("held"),
        ),
    )
    scored = F.transform(
        "_places",
        lambda p: F.struct(
            (-F.size(F.array_distinct(p["held"]))).alias("terms"),
            (-F.size(p["held"])).alias("hits"),
            F.greatest(p["at"] - lead, F.lit(1)).alias("begin"),
            (p["at"] + width - 1).alias("end"),
        ),
    )

    def with_next(chosen: Column, place: Column) -> Column:
        meets = F.exists(chosen, lambda c: (c["begin"] <= place["end"]) & (place["begin"] <= c["end"]))
        taken = F.array_append(chosen, F.struct(place["begin"].alias("begin"), place["end"].alias("end")))
        return F.when((F.size(chosen) < fragments) & ~meets, taken).otherwise(chosen)

    chosen = F.aggregate(F.sort_array("_scored"), F.array().cast("array<struct<begin:int,end:int>>"), with_next)
    shown = F.transform("_chosen", lambda c: _marked(F.slice("_pieces", c["begin"], c["end"] - c["begin"] + 1)))
    return (
        _in_pieces(page_rows, terms, small)
        .withColumn("_hits", F.filter(numbered, lambda h: F.array_contains("_terms", h["term"])))
        .withColumn("_places", places)
        .withColumn("_scored", scored)
        .withColumn("_chosen", F.sort_array(chosen))
        .withColumn("snippet", F.when(F.size("_chosen") > 0, F.array_join(shown, "...")).otherwise(_head(F.col("composite_text"))))
        .drop("_terms", "_pieces", "_hits", "_places", "_scored", "_chosen")
    )


def search_result_record(
    page_rows: DataFrame, docs: DataFrame, small: bool | None = None, keys: list[str] | None = None
) -> DataFrame:
    """Page rows with the fields of their documents and all of them once more as ``full_record``.

    Page rows are few; broadcast, they pick their documents without moving the others. ``keys``, those of the rows where they
    are known, go down to the files.
    """
    docs = docs if keys is None else docs.where(F.col("key").isin(keys))
    fields = docs.select("*", F.struct(*docs.columns).alias("full_record"))
    return fields.join(small_side(page_rows, small=small), "key")
