"""Analysis, index and searches."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.plans.search import search_batch
from pageloom.queries import query
from pageloom.queries.inputs import once, store, table
from pageloom.queries.scalars import SEARCH_DOCS
from pageloom.search import analysis, grammar, index as index_module, match, modes, rank, results, segments
from pageloom.session import staged

_TOKEN = r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*"
_STOP = ", ".join(f"'{w}'" for w in analysis.STOP_WORDS)
_KEPT = f"length(t) >= 2 AND t NOT IN ({_STOP})"


def _tokens(text: str) -> str:
    return f"list_filter(regexp_extract_all(lower({text}), '{_TOKEN}'), lambda t: {_KEPT})"


FIELDS = """unique_docs AS (SELECT * FROM docs QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos) = 1),
fields AS (SELECT key, 'title' AS field, title AS text FROM unique_docs UNION ALL SELECT key, 'url', url FROM unique_docs
  UNION ALL SELECT key, 'content', content FROM unique_docs UNION ALL SELECT key, 'summary', summary FROM unique_docs
  UNION ALL SELECT key, 'composite_text', composite_text FROM unique_docs)"""


def _postings_sql(only: str = "") -> str:
    return f"""{SEARCH_DOCS}, {FIELDS},
tokened AS (SELECT key, field, {_tokens("text")} AS toks FROM fields {only}),
spots AS (SELECT key, field, len(toks) AS dl, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS position FROM tokened),
postings AS (SELECT field, term, key, dl, count(*) AS tf, list(position ORDER BY position) AS positions FROM spots GROUP BY ALL),
vocabulary AS (SELECT field, term, count(*) AS df FROM postings GROUP BY ALL),
corpus AS (SELECT field, (SELECT count(*) FROM unique_docs) AS n_docs, sum(tf) / (SELECT count(*) FROM unique_docs) AS avg_len FROM postings GROUP BY field)"""


POSTINGS = _postings_sql()
COMPOSITE = _postings_sql("WHERE field = 'composite_text'")


def the_index(spark, sf):
    """The index of the store, written once and then opened, as searches do."""

    def make(path):
        index_module.build_index(index_module.search_doc_prepare(store(spark, sf)), path, buckets=8)

    return index_module.read_index(spark, once(spark, sf, "index", make))


def benchmark_queries(spark, sf):
    """Each benchmark text as a query."""
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


QUERY_TERMS = f"""qterms0 AS (SELECT item_id AS query_id, {_tokens("text")} AS toks FROM benchmark),
qterms AS (SELECT query_id, len(toks) AS n_terms, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS ord FROM qterms0)"""

# Characters beyond ASCII become capitals, which lower-cased terms never hold: a byte per letter for levenshtein.
_FOREIGN = "êüíèñéßçäóöúáàâîïôûëùœæå¿¡"


def _bytes(term: str) -> str:
    return f"translate({term}, '{_FOREIGN}', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ')"


@query(
    "analyze_text",
    f"""WITH t AS (SELECT doc_id, {_tokens("text")} AS toks FROM documents)
    SELECT doc_id, unnest(toks) AS term, CAST(generate_subscripts(toks, 1) - 1 AS INT) AS position FROM t""",
)
def _(spark, sf):
    return analysis.analyze_text(table(spark, sf, "documents").select("doc_id", "text"), "text").select("doc_id", "term", "position")


@query(
    "postings_build",
    f"WITH {POSTINGS} SELECT field, term, key, dl, tf, array_to_string(positions, ',') AS positions FROM postings",
)
def _(spark, sf):
    built = index_module.postings_build(index_module.search_doc_prepare(store(spark, sf)))
    positions = F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions")
    return built.postings.select("field", "term", "key", "dl", "tf", positions)


@query("corpus_stats", f"WITH {POSTINGS} SELECT field, term, df FROM vocabulary")
def _(spark, sf):
    built = index_module.postings_build(index_module.search_doc_prepare(store(spark, sf)))
    vocabulary, _corpus = index_module.corpus_stats(built.postings, built.docs)
    return vocabulary.select("field", "term", "df")


@query("corpus_sizes", f"WITH {POSTINGS} SELECT field, n_docs, round(avg_len, 6) AS avg_len FROM corpus")
def _(spark, sf):
    built = index_module.postings_build(index_module.search_doc_prepare(store(spark, sf)))
    return built.corpus.select("field", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("index_scan_count", f"WITH {SEARCH_DOCS} SELECT count(DISTINCT key) AS n_docs FROM docs")
def _(spark, sf):
    return index_module.index_scan_count(the_index(spark, sf))


_ALL_POSTINGS = f"WITH {POSTINGS} SELECT field, term, key, dl, tf, array_to_string(positions, ',') AS positions FROM postings"


def _shown_postings(postings):
    return postings.select("field", "term", "key", "dl", "tf", F.array_join(F.col("positions").cast("array<string>"), ",").alias("positions"))


def grown_index(spark, sf):
    """An index of every fifth document, to which the others were added in four turns; like segments were merged on the way."""

    def make(path):
        docs = staged(index_module.search_doc_prepare(store(spark, sf)), "docs")
        index_module.build_index(docs.where("pos % 5 = 0"), path, buckets=8)
        for turn in range(1, 5):
            # Each turn brings all documents so far once more: those that are there stay.
            segments.index_append(docs.where(F.col("pos") % 5 <= turn), path)

    return index_module.read_index(spark, once(spark, sf, "grown-index", make))


@query("index_update", _ALL_POSTINGS)
def _(spark, sf):
    return _shown_postings(grown_index(spark, sf).postings)


@query("index_update_plan", _ALL_POSTINGS)
def _(spark, sf):
    """An index of the rows without a summary, completed with all rows as a plan."""
    docs = index_module.search_doc_prepare(store(spark, sf))

    def make(path):
        index_module.build_index(docs.where("summary = ''"), path, buckets=8)

    old = index_module.read_index(spark, once(spark, sf, "half-index", make))
    return _shown_postings(index_module.index_update(old, docs).postings)


@query("index_update_sizes", f"WITH {POSTINGS} SELECT field, term, df, n_docs, round(avg_len, 6) AS avg_len FROM vocabulary JOIN corpus USING (field)")
def _(spark, sf):
    grown = grown_index(spark, sf)
    return grown.vocabulary.join(F.broadcast(grown.corpus), "field").select("field", "term", "df", "n_docs", F.round("avg_len", 6).alias("avg_len"))


@query("query_terms", f"WITH {QUERY_TERMS} SELECT query_id, CAST(ord AS INT) AS ord, term, CAST(n_terms AS INT) AS n_terms, 0 AS maxdist FROM qterms")
def _(spark, sf):
    return analysis.query_terms(benchmark_queries(spark, sf)).select("query_id", "ord", "term", "n_terms", "maxdist")


def _fuzzy_texts(spark, sf, distance=1):
    """Benchmark texts with ``~<distance>`` after every word of three letters or more."""
    return benchmark_queries(spark, sf).withColumn("text", F.regexp_replace("text", r"([\p{L}\p{N}_]{3,})", f"$1~{distance}"))


def _cuts(word: str, distance: int) -> str:
    """The word and what is left of it after up to ``distance`` letters go; words that many edits apart share one of these."""
    cuts = f"[{word}]"
    for _ in range(distance):
        cuts = f"list_distinct({cuts} || flatten(list_transform({cuts}, lambda c: list_transform(range(1, length(c) + 1), lambda i: substr(c, 1, i - 1) || substr(c, i + 1)))))"
    return cuts


def _expanded(distance: int) -> str:
    return f"""wanted AS (SELECT *, CASE WHEN length(term) >= 3 THEN {distance} ELSE 0 END AS maxdist FROM qterms),
vword AS MATERIALIZED (SELECT term, df, {_bytes("term")} AS b FROM vocabulary WHERE field = 'composite_text'),
wword AS MATERIALIZED (SELECT DISTINCT term, {_bytes("term")} AS b FROM wanted WHERE maxdist > 0),
vcut AS (SELECT term, b, unnest({_cuts("b", distance)}) AS cut FROM vword),
wcut AS (SELECT term, b, unnest({_cuts("b", distance)}) AS cut FROM wword),
met AS (SELECT DISTINCT w.term, w.b AS wb, v.term AS word, v.b AS vb FROM wcut w JOIN vcut v USING (cut)),
distinct_pairs AS (SELECT term, word FROM met WHERE levenshtein(vb, wb) <= {distance}),
expanded AS MATERIALIZED (SELECT query_id, ord, n_terms, v.term, df, false AS fuzzy FROM wanted w JOIN vword v ON v.term = w.term WHERE maxdist = 0
  UNION ALL SELECT query_id, ord, n_terms, v.term, df, true FROM wanted w JOIN distinct_pairs d ON d.term = w.term JOIN vword v ON v.term = d.word WHERE maxdist > 0)"""


def _fuzzy_join(spark, sf, distance):
    terms = match.with_field(analysis.query_terms(_fuzzy_texts(spark, sf, distance)))
    return match.fuzzy_lookup(the_index(spark, sf), terms).select("query_id", "ord", "term", "df")


_FUZZY = "SELECT query_id, CAST(ord AS INT) AS ord, term, df FROM expanded WHERE fuzzy"


@query("fuzzy_term_join", f"WITH {COMPOSITE}, {QUERY_TERMS}, {_expanded(1)} {_FUZZY}")
def _(spark, sf):
    return _fuzzy_join(spark, sf, 1)


@query("fuzzy_term_join_2", f"WITH {COMPOSITE}, {QUERY_TERMS}, {_expanded(2)} {_FUZZY}")
def _(spark, sf):
    return _fuzzy_join(spark, sf, 2)


@query("fuzzy_term_pieces", f"WITH {COMPOSITE}, {QUERY_TERMS}, {_expanded(1)} {_FUZZY}")
def _(spark, sf):
    """The same without an index on disk: words meet on pieces that edits leave whole."""
    terms = analysis.query_terms(_fuzzy_texts(spark, sf, 1))
    vocabulary = the_index(spark, sf).vocabulary.where("field = 'composite_text'").select("term", "df")
    return match.fuzzy_term_join(terms, vocabulary).select("query_id", "ord", "term", "df")


@query(
    "postings_join",
    f"""WITH {COMPOSITE}, {QUERY_TERMS} SELECT query_id, CAST(ord AS INT) AS ord, q.term, key, tf, CAST(dl AS INT) AS dl FROM qterms q JOIN postings p USING (term)""",
)
def _(spark, sf):
    idx = the_index(spark, sf)
    terms = analysis.query_terms(benchmark_queries(spark, sf))
    return match.matches(idx, terms).select("query_id", "ord", "term", "key", "tf", "dl")


_ALL_TERMS = """SELECT query_id, key FROM qterms q JOIN postings p USING (term) GROUP BY query_id, key, n_terms HAVING count(*) = n_terms"""


@query("search_exact", f"WITH {COMPOSITE}, {QUERY_TERMS} {_ALL_TERMS}")
def _(spark, sf):
    return match.search_exact(the_index(spark, sf), benchmark_queries(spark, sf))


@query(
    "search_fuzzy",
    f"""WITH {COMPOSITE}, {QUERY_TERMS}, {_expanded(1)} SELECT query_id, key FROM expanded e JOIN postings p USING (term)
    GROUP BY query_id, key, n_terms HAVING count(DISTINCT ord) = n_terms""",
)
def _(spark, sf):
    return match.search_fuzzy(the_index(spark, sf), _fuzzy_texts(spark, sf))


# Short queries: every distinct word of the benchmark texts.
WORD_QUERIES = f"""words AS (SELECT DISTINCT term FROM (SELECT unnest({_tokens("text")}) AS term FROM benchmark)),
wqueries AS (SELECT term AS query_id, term FROM words)"""


def word_queries(spark, sf):
    """Every distinct benchmark word as a query named after itself."""
    terms = analysis.analyze_text(table(spark, sf, "benchmark").select("text"), "text")
    return terms.select(F.col("term").alias("query_id"), F.col("term").alias("text")).distinct()


_BM25 = """(ln(c.n_docs / (v.df + 1)) + 1) * p.tf * 2.2 / (p.tf + 1.2 * (0.25 + 0.75 * p.dl / c.avg_len))"""
SCORED = f"""scored AS (SELECT query_id, key, round(sum({_BM25}), 6) AS score
  FROM wqueries q JOIN postings p USING (term) JOIN vocabulary v ON v.term = p.term AND v.field = p.field JOIN corpus c ON c.field = p.field
  GROUP BY query_id, key)"""


def word_scores(spark, sf):
    idx = the_index(spark, sf)
    return rank.bm25_scores(*match.parted_matches(idx, analysis.query_terms(word_queries(spark, sf))), idx)


@query("bm25_score", f"WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED} SELECT query_id, key, score FROM scored")
def _(spark, sf):
    return word_scores(spark, sf)


_TEXT_SCORED = f"""tscored AS (SELECT query_id, key, round(sum({_BM25}), 6) AS score FROM qterms q JOIN postings p USING (term)
  JOIN vocabulary v ON v.term = p.term AND v.field = p.field JOIN corpus c ON c.field = p.field
  GROUP BY query_id, key, n_terms HAVING count(*) = n_terms)"""


@query("bm25_score_grown", f"WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED} SELECT query_id, key, score FROM scored")
def _(spark, sf):
    """Scores from an index that grew by segments are those of one built at once."""
    idx = grown_index(spark, sf)
    return rank.bm25_scores(*match.parted_matches(idx, analysis.query_terms(word_queries(spark, sf))), idx)


@query("bm25_score_texts", f"WITH {COMPOSITE}, {QUERY_TERMS}, {_TEXT_SCORED} SELECT query_id, key, score FROM tscored")
def _(spark, sf):
    idx = the_index(spark, sf)
    return rank.bm25_scores(*match.parted_matches(idx, analysis.query_terms(benchmark_queries(spark, sf))), idx)


@query("search_total_hits", f"WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED} SELECT query_id, count(*) AS total_results FROM scored GROUP BY query_id")
def _(spark, sf):
    return rank.search_total_hits(word_scores(spark, sf))


# Requests for the words: page and size follow from the length of the word, page 9 is past the end of many.
_ASKED = """asked AS (SELECT query_id, CASE WHEN length(term) > 6 THEN 9 WHEN length(term) > 4 THEN 2 ELSE 1 END AS page,
  CASE WHEN length(term) > 6 THEN 7 ELSE 20 END AS page_size FROM wqueries)"""
_PAGED = """totals AS (SELECT query_id, count(*) AS total_results FROM scored GROUP BY query_id),
pagination AS (SELECT query_id, page, page_size, coalesce(total_results, 0) AS total_results,
  CAST(ceil(coalesce(total_results, 0) / page_size) AS BIGINT) AS total_pages FROM asked LEFT JOIN totals USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, key) AS rank FROM scored),
paged AS (SELECT query_id, rank, key, score FROM ranked JOIN pagination USING (query_id)
  WHERE rank > (least(page, total_pages) - 1) * page_size AND rank <= least(page, total_pages) * page_size)"""


def _requests(spark, sf):
    n = F.length("text")
    return word_queries(spark, sf).withColumns(
        {"page": F.when(n > 6, 9).when(n > 4, 2).otherwise(1), "page_size": F.when(n > 6, 7).otherwise(20)}
    )


@query(
    "pagination_meta",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED}
    SELECT *, page < total_pages AS has_next, page > 1 AS has_prev FROM pagination""",
)
def _(spark, sf):
    return rank.pagination_meta(rank.search_total_hits(word_scores(spark, sf)), _requests(spark, sf))


@query("search_page", f"WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED} SELECT query_id, rank, key, score FROM paged")
def _(spark, sf):
    scored = staged(word_scores(spark, sf), "scored")
    return rank.search_page(scored, rank.pagination_meta(rank.search_total_hits(scored), _requests(spark, sf)))


@query("search_page_deep", f"WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED} SELECT query_id, rank, key, score FROM paged")
def _(spark, sf):
    scored = staged(word_scores(spark, sf), "scored")
    pagination = rank.pagination_meta(rank.search_total_hits(scored), _requests(spark, sf))
    return rank.search_page(scored, pagination, shallow_rows=0)


# Boolean: the first word of a benchmark text must be there, the last must not, those between may.
_BOOLEAN = f"""clauses AS (SELECT item_id AS query_id, {_tokens("text")} AS toks FROM benchmark),
bool AS (SELECT query_id, toks[1] AS must, toks[2:len(toks) - 1] AS should, toks[-1] AS must_not FROM clauses)"""


@query(
    "search_boolean",
    f"""WITH {COMPOSITE}, {_BOOLEAN},
    role_terms AS (SELECT query_id, 'must' AS role, 0 AS ord, must AS term FROM bool WHERE length(must) > 3
      UNION ALL SELECT query_id, 'should', generate_subscripts(should, 1), unnest(should) FROM bool
      UNION ALL SELECT query_id, 'must_not', 0, must_not FROM bool),
    hits AS (SELECT query_id, role, ord, key, {_BM25} AS part FROM role_terms q JOIN postings p USING (term)
      JOIN vocabulary v ON v.term = p.term AND v.field = p.field JOIN corpus c ON c.field = p.field),
    grouped AS (SELECT query_id, key, count(*) FILTER (role = 'must') AS n_found, count(*) FILTER (role = 'must_not') AS n_banned,
      round(sum(part) FILTER (role <> 'must_not'), 6) AS score FROM hits GROUP BY query_id, key),
    needed AS (SELECT query_id, count(*) FILTER (role = 'must') AS n_must FROM role_terms GROUP BY query_id)
    SELECT query_id, key, score FROM grouped JOIN needed USING (query_id) WHERE n_banned = 0 AND n_found = n_must AND score IS NOT NULL""",
)
def _(spark, sf):
    toks = F.col("_t")
    first = F.get(toks, F.lit(0))
    clauses = benchmark_queries(spark, sf).withColumn("_t", analysis.tokens(F.col("text"))).select(
        "query_id", F.when(F.length(first) > 3, first).alias("must"),
        F.array_join(F.slice("_t", F.lit(2), F.greatest(F.size("_t") - 2, F.lit(0))), " ").alias("should"),
        F.element_at(toks, -1).alias("must_not"),
    )
    return modes.search_boolean(the_index(spark, sf), clauses)


# Phrases: each sentence line of the benchmark texts.
_PHRASES = f"""phrases AS (SELECT item_id || '-' || i AS query_id, {_tokens("line")} AS toks FROM (SELECT item_id, unnest(string_split(text, '.')) AS line,
    generate_subscripts(string_split(text, '.'), 1) AS i FROM benchmark)),
  pterms AS (SELECT query_id, len(toks) AS n_terms, unnest(toks) AS term, generate_subscripts(toks, 1) - 1 AS ord FROM phrases)"""


@query(
    "search_phrase",
    f"""WITH {COMPOSITE}, {_PHRASES} SELECT DISTINCT query_id, key FROM (SELECT query_id, key, position - ord AS begin, n_terms
      FROM pterms JOIN spots USING (term) GROUP BY ALL HAVING count(*) = n_terms)""",
)
def _(spark, sf):
    lines = table(spark, sf, "benchmark").select("item_id", F.posexplode(F.split("text", "[.]")).alias("i", "text"))
    named = lines.select(F.concat_ws("-", F.col("item_id"), F.col("i") + 1).alias("query_id"), "text")
    return modes.search_phrase(the_index(spark, sf), named)


# Query strings with operators, made of the words w1, w2 ... of a benchmark text: two of the first three, or a phrase of the next two and a word of
# the title (the second and third stand there twice, and count twice); not the last but one; and a wildcard or any word of the rest.
_ASKED_STRINGS = f"""strings AS (SELECT item_id AS query_id, {_tokens("text")} AS w FROM benchmark),
asked AS (SELECT * FROM strings WHERE len(w) >= 8),
leaves AS (SELECT query_id, 'word' AS kind, i AS leaf, 'composite_text' AS field, w[i] AS term FROM asked, unnest([1, 2, 3]) AS t(i)
  UNION ALL SELECT query_id, 'word', 3 * i - 1 + i % 2, 'composite_text', w[i] FROM asked, unnest([2, 3]) AS t(i)
  UNION ALL SELECT query_id, 'word', 6, 'title', 'page' FROM asked
  UNION ALL SELECT query_id, 'word', 7, 'composite_text', w[-2] FROM asked
  UNION ALL SELECT query_id, 'word', 10 + i, 'composite_text', w[i] FROM asked, unnest(range(6, len(w) - 1)) AS t(i)),
word_hits AS (SELECT query_id, leaf, key, ANY_VALUE({{BM25}}) AS part FROM leaves q JOIN postings p ON p.term = q.term AND p.field = q.field
  JOIN vocabulary v ON v.term = p.term AND v.field = p.field JOIN corpus c ON c.field = p.field GROUP BY ALL),
phrase_hits AS (SELECT a.query_id, 4 AS leaf, a.key, x.part + y.part AS part FROM
    (SELECT DISTINCT query_id, f.key FROM asked JOIN spots f ON f.term = w[4] AND f.field = 'composite_text'
      JOIN spots g ON g.term = w[5] AND g.field = 'composite_text' AND g.key = f.key AND g.position = f.position + 1) a
    JOIN (SELECT query_id, key, {{BM25}} AS part FROM asked q JOIN postings p ON p.term = w[4] AND p.field = 'composite_text'
      JOIN vocabulary v ON v.term = p.term AND v.field = p.field JOIN corpus c ON c.field = p.field) x ON x.query_id = a.query_id AND x.key = a.key
    JOIN (SELECT query_id, key, {{BM25}} AS part FROM asked q JOIN postings p ON p.term = w[5] AND p.field = 'composite_text'
      JOIN vocabulary v ON v.term = p.term AND v.field = p.field JOIN corpus c ON c.field = p.field) y ON y.query_id = a.query_id AND y.key = a.key),
wild_hits AS (SELECT DISTINCT query_id, 8 AS leaf, key, 1.0 AS part FROM asked JOIN postings p ON p.field = 'composite_text' AND p.term LIKE left(w[-1], 2) || '%'),
all_hits AS (SELECT * FROM word_hits UNION ALL SELECT * FROM phrase_hits UNION ALL SELECT * FROM wild_hits),
met AS (SELECT query_id, key, bool_or(leaf = 1) AS a, bool_or(leaf = 2) AS b, bool_or(leaf = 3) AS c, bool_or(leaf = 4) AS d, bool_or(leaf = 6) AS e,
  bool_or(leaf = 7) AS f, bool_or(leaf = 8) AS g, bool_or(leaf > 10) AS h, round(sum(part) FILTER (leaf <> 7), 6) AS score FROM all_hits GROUP BY query_id, key)"""


@query(
    "search_query",
    f"""WITH {POSTINGS}, {_ASKED_STRINGS.replace("{BM25}", _BM25)} SELECT query_id, key, score FROM met
    WHERE ((a AND (b OR c)) OR (b AND c) OR (d AND e)) AND NOT f AND (g OR h)""",
)
def _(spark, sf):
    w = F.col("_w")
    at = lambda i: F.element_at(w, i)
    rest = F.array_join(F.slice(w, F.lit(6), F.size(w) - 7), " OR ")
    text = F.concat(
        F.lit("("), at(1), F.lit(" ("), at(2), F.lit(" OR "), at(3), F.lit(") OR "), at(2), F.lit(" AND "), at(3), F.lit(' OR "'), at(4), F.lit(" "), at(5), F.lit('" title:page) NOT '),
        at(-2), F.lit(" ("), F.left(at(-1), F.lit(2)), F.lit("*"), F.when(rest != "", F.concat(F.lit(" OR "), rest)).otherwise(""), F.lit(")"),
    )
    asked = benchmark_queries(spark, sf).withColumn("_w", analysis.tokens(F.col("text"))).where(F.size("_w") >= 8)
    return grammar.search_query(the_index(spark, sf), asked.select("query_id", text.alias("text")))


# Prefixes and wildcards made of the benchmark words, by the length of the word.
_PATTERNS = """patterns AS (SELECT query_id, CASE length(term) % 4 WHEN 0 THEN left(term, 3) || '%' WHEN 1 THEN '%' || right(term, 3)
  WHEN 2 THEN left(term, 1) || '_' || substring(term, 3) ELSE '%' || substring(term, 2, 4) || '%' END AS pattern FROM wqueries)"""


@query(
    "search_prefix",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {_PATTERNS},
    hit_terms AS (SELECT query_id, term FROM patterns JOIN (SELECT DISTINCT term FROM postings) t ON term LIKE pattern)
    SELECT DISTINCT query_id, key FROM hit_terms JOIN postings USING (term)""",
)
def _(spark, sf):
    return modes.search_prefix(the_index(spark, sf), _pattern_texts(spark, sf))


def _pattern_texts(spark, sf):
    t, n = F.col("text"), F.length("text") % 4
    pattern = (
        F.when(n == 0, F.concat(F.left(t, F.lit(3)), F.lit("*")))
        .when(n == 1, F.concat(F.lit("*"), F.right(t, F.lit(3))))
        .when(n == 2, F.concat(F.left(t, F.lit(1)), F.lit("?"), F.substring(t, 3, 1000)))
        .otherwise(F.concat(F.lit("*"), F.substring(t, 2, 4), F.lit("*")))
    )
    return word_queries(spark, sf).withColumn("text", pattern)


@query(
    "wildcard_terms",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {_PATTERNS} SELECT query_id, term, df FROM patterns
    JOIN (SELECT term, df FROM vocabulary WHERE field = 'composite_text') t ON term LIKE pattern""",
)
def _(spark, sf):
    """Words of an index by patterns, without the filed grams."""
    patterns = match.with_field(_pattern_texts(spark, sf).select("query_id", F.col("text").alias("pattern")))
    return modes.wildcard_terms(patterns, the_index(spark, sf).vocabulary.where("field = 'composite_text'")).select("query_id", "term", "df")


@query(
    "search_field",
    f"""WITH {POSTINGS}, fq AS (SELECT DISTINCT field || ' ' || text AS query_id, field, text FROM (
        SELECT 'title' AS field, 'Page ' || source AS text FROM documents UNION ALL SELECT 'url', source || '.example.com ' || lang FROM documents
        UNION ALL SELECT 'summary', 'summary of ' || source || ' in ' || lang FROM documents UNION ALL SELECT 'key', 'guid-' || doc_id FROM documents)),
    ft0 AS (SELECT query_id, field, {_tokens("text")} AS toks FROM fq WHERE field <> 'key'),
    ft AS (SELECT query_id, field, len(toks) AS n_terms, unnest(toks) AS term FROM ft0)
    SELECT query_id, key FROM ft JOIN postings USING (field, term) GROUP BY query_id, key, n_terms HAVING count(*) = n_terms
    UNION ALL SELECT query_id, key FROM fq JOIN unique_docs ON key = text WHERE field = 'key'""",
)
def _(spark, sf):
    def ask(field, *words):
        return F.struct(F.lit(field).alias("field"), F.concat(*words).alias("text"))

    doc_id = F.col("doc_id").cast("string")
    texts = F.array(
        ask("title", F.lit("Page "), "source"),
        ask("url", "source", F.lit(".example.com "), "lang"),
        ask("summary", F.lit("summary of "), "source", F.lit(" in "), "lang"),
        ask("key", F.lit("guid-"), doc_id),
    )
    asked = table(spark, sf, "documents").select(F.explode(texts).alias("q")).select(
        F.concat_ws(" ", "q.field", "q.text").alias("query_id"), "q.field", "q.text"
    )
    return modes.search_field(the_index(spark, sf), asked.distinct())


# Requests as they come in, with faults that follow from the event.
@query(
    "request_validate",
    """WITH r AS (SELECT event_id AS query_id, CASE WHEN event_type = 'error' THEN '  ' ELSE event_type END AS text,
      CASE WHEN value < 3 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS page, CAST(CAST(floor(value) AS BIGINT) AS VARCHAR) AS page_size FROM events)
    SELECT query_id, CASE WHEN trim(text) = '' THEN 'Query parameter is required'
      WHEN coalesce(TRY_CAST(page AS BIGINT) >= 1 AND TRY_CAST(page_size AS BIGINT) BETWEEN 1 AND 100, false) THEN 'ok'
      ELSE 'Invalid pagination parameters: page >= 1, 1 <= page_size <= 100' END AS status FROM r""",
)
def _(spark, sf):
    return rank.request_validate(_event_requests(spark, sf)).select("query_id", "status")


def _event_requests(spark, sf):
    return table(spark, sf, "events").select(
        F.col("event_id").alias("query_id"),
        F.when(F.col("event_type") == "error", "  ").otherwise(F.col("event_type")).alias("text"),
        F.when(F.col("value") < 3, "x").otherwise(F.col("user_id").cast("string")).alias("page"),
        F.floor("value").cast("string").alias("page_size"),
    )


@query(
    "request_clamp",
    """SELECT event_id AS query_id, CASE WHEN value < 3 THEN 1 ELSE greatest(1, user_id) END AS page,
      least(100, greatest(1, CAST(floor(value) AS BIGINT))) AS page_size FROM events""",
)
def _(spark, sf):
    return rank.request_validate(_event_requests(spark, sf), "clamp").select("query_id", "page", "page_size")


_SNIPPETS = rf"""cut AS (SELECT *, regexp_extract_all(composite_text, '{_TOKEN}|[^\p{{L}}\p{{N}}_]+') AS pieces FROM shown),
spot AS (SELECT *, list_position(list_transform(pieces, lambda p: lower(p) = query_id), true) AS f FROM cut),
marked AS (SELECT *, CASE WHEN f > 0 THEN array_to_string(list_transform(pieces[greatest(f - 20, 1):f + 20],
    lambda p: CASE WHEN lower(p) = query_id THEN '<b>' || p || '</b>' ELSE p END), '') ELSE left(composite_text, 200) || '...' END AS snippet FROM spot)"""


@query(
    "search_snippet",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED},
    shown AS (SELECT query_id, rank, composite_text FROM paged JOIN unique_docs USING (key)), {_SNIPPETS}
    SELECT query_id, rank, snippet FROM marked""",
)
def _(spark, sf):
    idx = the_index(spark, sf)
    scored = staged(word_scores(spark, sf), "scored")
    page = rank.search_page(scored, rank.pagination_meta(rank.search_total_hits(scored), _requests(spark, sf)))
    rows = page.join(idx.docs.select("key", "composite_text"), "key")
    terms = word_queries(spark, sf).withColumnRenamed("text", "term")
    return results.search_snippet(rows, terms).select("query_id", "rank", "snippet")


# Words that begin alike are marked together; then three rounds, each takes the best place that meets none taken before.
_FREE = "NOT EXISTS (FROM {taken} t WHERE t.query_id = p.query_id AND t.rank = p.rank AND t.begin <= p.last AND p.begin <= t.last)"
_BEST = "SELECT * FROM places p WHERE {free} QUALIFY row_number() OVER (PARTITION BY query_id, rank ORDER BY terms DESC, hits DESC, spot) = 1"
_FRAGMENTS = rf"""alike AS MATERIALIZED (SELECT a.term AS query_id, b.term FROM words a JOIN words b ON left(a.term, 1) = left(b.term, 1)),
cut AS MATERIALIZED (SELECT *, regexp_extract_all(composite_text, '{_TOKEN}|[^\p{{L}}\p{{N}}_]+') AS pieces FROM shown),
pieced AS MATERIALIZED (SELECT query_id, rank, unnest(pieces) AS piece, generate_subscripts(pieces, 1) AS spot FROM cut),
hits AS MATERIALIZED (SELECT query_id, rank, spot, term FROM pieced JOIN alike USING (query_id) WHERE term = lower(piece)),
places AS MATERIALIZED (SELECT h.query_id, h.rank, h.spot, greatest(h.spot - 8, 1) AS begin, h.spot + 23 AS last, count(DISTINCT g.term) AS terms, count(*) AS hits
  FROM hits h JOIN hits g ON g.query_id = h.query_id AND g.rank = h.rank AND g.spot >= h.spot AND g.spot < h.spot + 24 GROUP BY ALL),
first_taken AS MATERIALIZED ({_BEST.format(free="true")}),
second_taken AS MATERIALIZED (FROM first_taken UNION ALL {_BEST.format(free=_FREE.format(taken="first_taken"))}),
taken AS MATERIALIZED (FROM second_taken UNION ALL {_BEST.format(free=_FREE.format(taken="second_taken"))}),
spans AS (SELECT t.query_id, t.rank, t.begin, string_agg(CASE WHEN h.term IS NULL THEN p.piece ELSE '<b>' || p.piece || '</b>' END, '' ORDER BY p.spot) AS span
  FROM taken t JOIN pieced p ON p.query_id = t.query_id AND p.rank = t.rank AND p.spot BETWEEN t.begin AND t.last
  LEFT JOIN hits h ON h.query_id = p.query_id AND h.rank = p.rank AND h.spot = p.spot GROUP BY ALL),
joined AS (SELECT query_id, rank, string_agg(span, '...' ORDER BY begin) AS spans FROM spans GROUP BY ALL)"""


@query(
    "search_fragments",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED},
    shown AS (SELECT query_id, rank, composite_text FROM paged JOIN unique_docs USING (key)), {_FRAGMENTS}
    SELECT query_id, rank, coalesce(spans, left(composite_text, 200) || '...') AS snippet FROM shown LEFT JOIN joined USING (query_id, rank)""",
)
def _(spark, sf):
    idx = the_index(spark, sf)
    scored = staged(word_scores(spark, sf), "scored")
    page = rank.search_page(scored, rank.pagination_meta(rank.search_total_hits(scored), _requests(spark, sf)))
    rows = page.join(idx.docs.select("key", "composite_text"), "key")
    words = word_queries(spark, sf).select(F.left("text", F.lit(1)).alias("initial"), "query_id")
    terms = words.join(words.withColumnRenamed("query_id", "term"), "initial").select("query_id", "term")
    return results.search_fragments(rows, terms).select("query_id", "rank", "snippet")


@query(
    "search_result_record",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED}
    SELECT query_id, rank, key, score, title, url, content, summary, sha256(composite_text) AS record_hash FROM paged JOIN unique_docs USING (key)""",
)
def _(spark, sf):
    idx = the_index(spark, sf)
    scored = staged(word_scores(spark, sf), "scored")
    page = rank.search_page(scored, rank.pagination_meta(rank.search_total_hits(scored), _requests(spark, sf)))
    rows = results.search_result_record(page, idx.docs)
    hashed = F.sha2("full_record.composite_text", 256).alias("record_hash")
    return rows.select("query_id", "rank", "key", "score", "title", "url", "content", "summary", hashed)


@query(
    "search_batch",
    f"""WITH {COMPOSITE}, {WORD_QUERIES}, {SCORED}, {_ASKED}, {_PAGED},
    shown AS (SELECT query_id, rank, key, score, title, url, summary, composite_text FROM paged JOIN unique_docs USING (key)), {_SNIPPETS}
    SELECT query_id, rank, key, score, title, url, summary, snippet, total_results, total_pages FROM marked JOIN pagination USING (query_id)""",
)
def _(spark, sf):
    found, pagination = search_batch(the_index(spark, sf), _requests(spark, sf))
    counts = pagination.select("query_id", "total_results", "total_pages")
    return found.select("query_id", "rank", "key", "score", "title", "url", "summary", "snippet").join(counts, "query_id")
