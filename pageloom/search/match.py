"""Query terms to index terms to postings."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.operators.sizing import BROADCAST_ROWS, holds_at_most, pinned, small_side
from pageloom.search.analysis import query_terms
from pageloom.search.index import Index, term_bucket
from pageloom.session import staged

FIELD = "composite_text"
# When the query terms are too many to broadcast: documents from which a term's
# posting list is split, and into how many parts.
HOT_POSTINGS = 100_000
# Terms up to this number are looked up in the files instead of scanned for.
PUSHED_TERMS = 1000
SALTS = 64
# Edits up to which an index on disk has its words filed by what is left of them.
FILED_EDITS = 2


def _start(length: Column, pieces: Column, i: Column) -> Column:
    """Where piece ``i`` begins (from 1) when a text of this length is cut into equal pieces."""
    return F.floor(length * i / pieces).cast("int") + 1


def _query_pieces(terms: DataFrame) -> DataFrame:
    """Terms with their k+1 pieces. An edit spoils one piece at most, so k edits leave one whole."""
    pieces = F.col("maxdist") + 1
    length = F.length("term")
    cut = F.transform(
        F.sequence(F.lit(0), F.col("maxdist")),
        lambda i: F.struct(
            i.alias("i"),
            F.substring(
                F.col("term"), _start(length, pieces, i), _start(length, pieces, i + 1) - _start(length, pieces, i)
            ).alias("piece"),
        ),
    )
    return terms.select("*", length.alias("len"), F.explode(cut).alias("_p")).select(
        *terms.columns, "len", "_p.i", "_p.piece"
    )


def _vocabulary_pieces(words: DataFrame, maxdist: int, lengths: list[int] | None = None) -> DataFrame:
    """For every length a query may have (of ``lengths``, where they are known), the substrings of a vocabulary term that can equal a piece."""
    word_len = F.length("word")
    k, pieces = F.lit(maxdist), F.lit(maxdist + 1)
    near = F.sequence(F.greatest(word_len - k, F.lit(1)), word_len + k)
    if lengths is not None:
        words = words.where(word_len.between(min(lengths) - maxdist, max(lengths) + maxdist))
        near = F.array_intersect(near, F.array(*map(F.lit, lengths)))
    placed = words.select("*", F.explode(near).alias("len")).select("*", F.explode(F.sequence(F.lit(0), k)).alias("i"))
    begin = _start(F.col("len"), pieces, F.col("i"))
    placed = placed.select("*", begin.alias("_from"), (_start(F.col("len"), pieces, F.col("i") + 1) - begin).alias("_n"))
    first = F.greatest(F.col("_from") - k, F.lit(1))
    last = F.least(F.col("_from") + k, F.length("word") - F.col("_n") + 1)
    spots = F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    substrings = F.array_distinct(F.transform(spots, lambda at: F.substring(F.col("word"), at, F.col("_n"))))
    return placed.select(*words.columns, F.lit(maxdist).alias("maxdist"), "len", "i", F.explode(substrings).alias("piece"))


@dataclass(frozen=True)
class Footprint:
    """What a set of terms touches, found in one pass over it. All parts are small by nature:
    at most ten distances, the fields of the index, its buckets, and where they are few the terms themselves and the lengths of the
    fuzzy ones."""

    rows: int
    distances: list[int]
    fields: list[str]
    buckets: list[int]
    terms: list[str] | None = None
    lengths: list[int] | None = None

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS


def footprint(terms: DataFrame, buckets: int) -> Footprint:
    """Measure terms ``(field, term, …)``."""
    distance = F.col("maxdist") if "maxdist" in terms.columns else F.lit(0)
    row = terms.agg(
        F.count(F.lit(1)),
        F.sort_array(F.collect_set(distance)),
        F.sort_array(F.collect_set("field")),
        F.sort_array(F.collect_set(term_bucket(F.col("term"), buckets))),
    ).first()
    return Footprint(row[0], [d for d in row[1] if d > 0], row[2], row[3])


def surveyed(terms: DataFrame, buckets: int, name: str | None = None) -> tuple[DataFrame, Footprint]:
    """Terms and what they touch. Few terms become a local table; many are staged, if the staged table gets a ``name``."""
    few = pinned(terms.withColumn("_bucket", term_bucket(F.col("term"), buckets)), PUSHED_TERMS)
    if few is None:
        many = staged(terms, name) if name else terms
        return many, footprint(many, buckets)
    local, rows = few

    def held(column: str) -> list:
        return sorted({r[column] for r in rows if r.get(column) is not None})

    distances = [d for d in held("maxdist") if d > 0]
    lengths = sorted({len(r["term"]) for r in rows if r.get("maxdist")})
    return local.drop("_bucket"), Footprint(len(rows), distances, held("field"), held("_bucket"), held("term"), lengths)


def within(filed: DataFrame, touched: Footprint, by_term: bool = True) -> DataFrame:
    """Rows of the fields and buckets that are touched; Spark prunes the other folders.

    Few terms go down to the files too, where terms are in order.
    """
    if not touched.rows:
        return filed.where(F.lit(False))
    kept = filed.where(F.col("field").isin(touched.fields))
    if not by_term:
        return kept
    kept = kept.where(F.col("bucket").isin(touched.buckets))
    return kept if touched.terms is None else kept.where(F.col("term").isin(touched.terms))


def fuzzy_term_join(
    terms: DataFrame, vocab: DataFrame, distances: list[int] | None = None, lengths: list[int] | None = None
) -> DataFrame:
    """Query terms with the vocabulary terms within their edit distance.

    ``terms(…, term, maxdist)`` and ``vocab(term, df)`` give the terms' other
    columns with ``term`` and ``df`` of the vocabulary; with a ``field`` on both
    sides only terms of the same field meet. A query term is cut into maxdist+1
    pieces; a vocabulary term that is near enough holds one of them, moved by at
    most maxdist places. So candidates come from an equi-join on distance,
    length, number of the piece and piece, never from pairing everything with
    everything, and ``levenshtein`` decides. A term that many queries share is
    compared once.
    """
    keys = [c for c in ("field", "term", "maxdist") if c in terms.columns and c in (*vocab.columns, "maxdist")]
    near = terms.where("maxdist > 0")
    if distances is None:
        # At most nine values: the distance is a single digit.
        distances = sorted(r[0] for r in near.select("maxdist").distinct().collect())
    by_field = [c for c in keys if c == "field"]
    carried = [c for c in terms.columns if c not in ("term", "maxdist")]
    if not distances:
        return near.join(vocab.select(*by_field, "term", "df"), [*by_field, "term"]).select(*carried, "term", "df")
    words = vocab.select(*by_field, F.col("term").alias("word"), "df")
    pieces = _vocabulary_pieces(words, distances[0], lengths)
    for k in distances[1:]:
        pieces = pieces.unionByName(_vocabulary_pieces(words, k, lengths))
    # A term no longer than its distance has empty pieces, which every word shows: that key is spread by the word.
    empty = F.col("piece") == ""
    pieces = pieces.withColumn("_salt", F.when(empty, F.pmod(F.xxhash64("word"), F.lit(SALTS))).otherwise(0).cast("int"))
    salts = F.explode(F.sequence(F.lit(0), F.when(empty, SALTS - 1).otherwise(0)))
    wanted = small_side(_query_pieces(near.select(*keys).distinct()).withColumn("_salt", salts))
    pairs = (
        pieces.join(wanted, [*by_field, "maxdist", "len", "i", "piece", "_salt"])
        .where("levenshtein(term, word, CAST(maxdist AS INT)) >= 0")
        .select(*keys, "word", "df")
        .distinct()
    )
    return near.join(pairs, keys).select(*carried, F.col("word").alias("term"), "df")


def picked(filed: DataFrame, keys: DataFrame, column: str, buckets: int) -> DataFrame:
    """Rows of a table filed by ``column`` that meet ``keys``: few keys go down to the files, others prune folders, and a counted few are broadcast."""
    wanted = keys.select(column).distinct()
    few = pinned(wanted, PUSHED_TERMS)
    if few is None:
        return filed.join(small_side(keys), column)
    local, rows = few
    if not rows:
        return filed.where(F.lit(False)).join(F.broadcast(keys), column)
    touched = local.select(F.sort_array(F.collect_set(term_bucket(F.col(column), buckets)))).first()[0]
    return filed.where(F.col("bucket").isin(touched) & F.col(column).isin([r[column] for r in rows])).join(small_side(keys), column)


def made_once(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a local table when it has few rows, else staged."""
    few = pinned(df, PUSHED_TERMS)
    return staged(df, name) if few is None else few[0]


def fuzzy_lookup(index: Index, terms: DataFrame) -> DataFrame:
    """``fuzzy_term_join`` through the deletions filed with an index, for distances up to the number of letters left out there.

    Only the query side is cut up: its heads with letters left out are looked up, these give heads, the heads words, and ``levenshtein`` decides on them.
    The vocabulary then gives fields and frequencies of those words alone.
    """
    from pageloom.search.segments import deletion_cuts

    near = terms.where("maxdist > 0")
    asked = near.select(F.col("term").alias("asked"), "maxdist").distinct()
    cuts = asked.select("*", F.explode(deletion_cuts(F.col("asked"))).alias("_c")).where("_c.d <= maxdist").select("asked", "maxdist", "_c.cut").distinct()
    # What was found is looked at several times, to count it, to choose folders and to join: made once.
    met = made_once(picked(index.deletions, cuts, "cut", index.buckets).where("d <= maxdist").select("asked", "maxdist", "head").distinct(), "heads-met")
    pairs = made_once(picked(index.heads, met, "head", index.buckets).where("levenshtein(asked, term, CAST(maxdist AS INT)) >= 0").select("asked", "maxdist", "term").distinct(), "pairs")
    words = near.withColumnRenamed("term", "asked").join(small_side(pairs), ["asked", "maxdist"]).drop("asked", "maxdist")
    local, touched = surveyed(words.distinct(), index.buckets, "words-found")
    return within(index.vocabulary, touched).select("field", "term", "df").join(small_side(local, small=touched.small), ["field", "term"])


def with_field(terms: DataFrame) -> DataFrame:
    """Terms without a field of their own look into the composite text."""
    return terms if "field" in terms.columns else terms.withColumn("field", F.lit(FIELD))


def expand_terms(index: Index, terms: DataFrame) -> DataFrame:
    """Query terms to index terms: the columns of ``terms`` with ``df`` and ``fuzzy`` for ``maxdist``."""
    terms, touched = surveyed(with_field(terms), index.buckets)
    plain = small_side(terms.where("maxdist = 0").drop("maxdist"), small=touched.small)
    exact = (
        within(index.vocabulary, touched)
        .select("field", "term", "df")
        .join(plain, ["field", "term"])
        .withColumn("fuzzy", F.lit(False))
    )
    if not touched.distances:
        return exact
    if index.deletions is not None and max(touched.distances) <= FILED_EDITS:
        found = fuzzy_lookup(index, terms)
        return exact.unionByName(found.select(*[c for c in exact.columns if c != "fuzzy"]).withColumn("fuzzy", F.lit(True)))
    words = within(index.vocabulary, touched, by_term=False)
    return exact.unionByName(fuzzy_term_join(terms, words, touched.distances, touched.lengths).withColumn("fuzzy", F.lit(True)))


def postings_join(
    expanded: DataFrame, postings: DataFrame, buckets: int, broadcast_rows: int = BROADCAST_ROWS, touched: Footprint | None = None, by_key: bool = False
) -> DataFrame:
    """Expanded terms ``(field, term, df, …)`` with their postings.

    A small set of terms is broadcast to the posting lists, which then stay
    where they are. A large one is joined by shuffle. There the list of a
    frequent term is spread by a salt that comes from the document, and only the
    rows of such a term are repeated per salt. How many terms can be that
    frequent follows from the number of postings.

    ``by_key`` brings the hits of a document together, without places, for groupings by query and document. A posting then moves once and meets
    its queries where it came to, so terms that many queries share are not moved for each of them.
    """
    keys = ["field", "term"]
    if touched is None:
        expanded, touched = surveyed(expanded, buckets)
    filed = within(postings, touched)
    if by_key:
        filed = filed.drop("positions", "bucket", "block", "seg")
    if touched.rows <= broadcast_rows:
        if by_key:
            filed = filed.join(F.broadcast(expanded.select(*keys).distinct()), keys, "left_semi").repartition("key")
        return filed.join(F.broadcast(expanded), keys)
    hot = small_side(expanded.where(F.col("df") > HOT_POSTINGS).select(*keys, F.lit(True).alias("_hot")).distinct())
    spread = F.when(F.col("_hot"), F.pmod(F.xxhash64("key"), F.lit(SALTS))).otherwise(0).cast("int")
    copies = F.sequence(F.lit(0), F.when(F.col("df") > HOT_POSTINGS, SALTS - 1).otherwise(0))
    hits = (
        filed.join(hot, keys, "left")
        .withColumn("_salt", spread)
        .drop("_hot")
        .join(expanded.withColumn("_salt", F.explode(copies)), [*keys, "_salt"])
        .drop("_salt")
    )
    return hits.repartition("query_id", "key") if by_key else hits


def matches(index: Index, terms: DataFrame, by_key: bool = False) -> DataFrame:
    """All hits of the terms: their columns with ``df, fuzzy, key, tf, dl, positions``.

    The expansion is looked at twice, to choose the folders to read and for the
    join, so it is staged, or local when it is small. With ``by_key`` the hits of a document are together, without places.
    """
    expanded, touched = surveyed(expand_terms(index, terms), index.buckets, "expanded")
    hits = postings_join(expanded, index.postings, index.buckets, touched=touched, by_key=by_key)
    return hits if by_key else hits.drop("bucket")


def found_alone(expanded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Expanded terms of the queries that have one term with one expansion, and those of the others.

    Such a query meets a document in one posting at most, so its hits need no grouping.
    """
    per_query = Window.partitionBy("query_id", "n_terms")
    counted = expanded.withColumn("_alone", (F.col("n_terms") == 1) & (F.count(F.lit(1)).over(per_query) == 1))
    return counted.where("_alone").drop("_alone"), counted.where("NOT _alone").drop("_alone")


def parted_matches(index: Index, terms: DataFrame) -> tuple[DataFrame | None, DataFrame | None]:
    """The hits of queries that are ``found_alone``, where they lie, and those of the others by document; None where there are no such queries."""
    expanded, touched = surveyed(expand_terms(index, terms), index.buckets, "expanded")
    return parted_join(index, expanded, touched)


def parted_join(index: Index, expanded: DataFrame, touched: Footprint) -> tuple[DataFrame | None, DataFrame | None]:
    """``parted_matches`` of expanded terms."""
    alone, others = found_alone(expanded)
    local = postings_join(alone, index.postings, index.buckets, touched=touched) if alone.take(1) else None
    moved = postings_join(others, index.postings, index.buckets, touched=touched, by_key=True) if others.take(1) or local is None else None
    return local, moved


def complete_parts(alone: DataFrame | None, others: DataFrame | None) -> DataFrame:
    """``complete`` of both parts of ``parted_matches``."""
    parts = [alone.select("query_id", "key")] if alone is not None else []
    parts += [complete(others)] if others is not None else []
    return reduce(DataFrame.unionByName, parts)


def complete(hits: DataFrame) -> DataFrame:
    """Documents in which every term of the query occurs: ``(query_id, key)``.

    Hits that are together by document serve both groupings.
    """
    return (
        hits.groupBy("query_id", "key", "n_terms", "ord")
        .agg(F.lit(1).alias("one"))
        .groupBy("query_id", "key", "n_terms")
        .agg(F.count(F.lit(1)).alias("found"))
        .where("found = n_terms")
        .select("query_id", "key")
    )


def search_exact(index: Index, queries: DataFrame) -> DataFrame:
    """Documents with all terms of a query: ``(query_id, key)``. Edit distances are ignored."""
    terms = query_terms(queries).withColumn("maxdist", F.lit(0))
    return complete_parts(*parted_matches(index, terms))


def complete_by_rarest(index: Index, expanded: DataFrame, touched: Footprint) -> DataFrame:
    """``complete`` of all hits of expanded terms, of which only those in documents with the rarest term of their query are made.

    A query with a term that has no expansion finds nothing. The rarest term is that whose expansions have the fewest postings.
    """
    per_query = ["query_id", "n_terms"]
    by_term = expanded.groupBy(*per_query, "ord").agg(F.sum("df").alias("df"))
    whole = by_term.groupBy(*per_query).agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("df", "ord")).alias("_rare")).where("_n = n_terms")
    chosen = made_once(whole.select(F.struct(*per_query).alias("_query"), F.col("_rare.ord").alias("_rare")), "rarest-terms")
    # A query without a name is one like any other: as a struct it is never NULL.
    known = expanded.withColumn("_query", F.struct(*per_query)).drop(*per_query).join(small_side(chosen), "_query").select("_query", "ord", "field", "term", "df", "_rare")
    known = made_once(known.distinct(), "terms-known")
    rare = known.where("ord = _rare").select("_query", "field", "term", "df")
    few = holds_at_most(known, BROADCAST_ROWS)
    near = postings_join(rare, index.postings, index.buckets).select("_query", F.struct("key").alias("_key")).distinct()
    near = staged(near, "documents-near")
    found = near.where("_query.n_terms = 1")
    rest = small_side(known.where("ord <> _rare").select("_query", "ord", "field", "term"), small=few)
    filed = within(index.postings, touched).select("field", "term", F.struct("key").alias("_key"))
    if few:
        filed = filed.join(F.broadcast(known.select("field", "term").distinct()), ["field", "term"], "left_semi")
    # A posting moves once, by its document, and meets there the queries that the document can answer, then their terms.
    met = filed.join(near.where("_query.n_terms > 1").select("_query", "_key"), "_key").join(rest, ["_query", "field", "term"])
    others = met.groupBy("_query", "_key", "ord").agg(F.lit(1).alias("one")).groupBy("_query", "_key").agg(F.count(F.lit(1)).alias("_n"))
    found = found.unionByName(others.where("_n = _query.n_terms - 1").select("_query", "_key"))
    return found.select("_query.query_id", "_key.key")


def search_fuzzy(index: Index, queries: DataFrame) -> DataFrame:
    """Documents with all terms of a query, each within its edit distance: ``(query_id, key)``."""
    expanded, touched = surveyed(expand_terms(index, query_terms(queries)), index.buckets, "expanded")
    alone, others = found_alone(expanded)
    parts = [postings_join(alone, index.postings, index.buckets, touched=touched).select("query_id", "key")] if alone.take(1) else []
    if others.take(1) or not parts:
        parts.append(complete_by_rarest(index, others, touched))
    return reduce(DataFrame.unionByName, parts)
