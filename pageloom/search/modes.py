"""Boolean, phrase, prefix and field searches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pageloom.operators.numbering import number_rows
from pageloom.operators.sizing import small_side
from pageloom.search.analysis import MIN_LENGTH, STOP_WORDS, TOKEN, is_kept, query_terms
from pageloom.search.gathering import gathered
from pageloom.search.index import Index
from pageloom.search.match import complete, complete_parts, expand_terms, made_once, matches, parted_matches, picked, postings_join, surveyed, with_field, within
from pageloom.search.rank import SCORE_DIGITS, scored_hits
from pageloom.search.segments import GRAM, HEAD, TAIL
from pageloom.session import staged

# Signs for any characters and for one character.
ANY, ONE = "*", "?"
KEY_CHARS = 4
# Terms with the numbers of their patterns that are broadcast at most: a row may hold many numbers.
NUMBERED_ROWS = 50_000

# A token that may hold the two signs.
_PATTERN = TOKEN.replace("_]", "_*?]")


def search_boolean(index: Index, queries: DataFrame) -> DataFrame:
    """``queries(query_id, must, should, must_not)``, each a text: ``(query_id, key, score)``.

    A document needs all ``must`` terms, or without any a ``should`` term, and no
    ``must_not`` term. One grouping of all hits decides; nothing is joined twice.
    """
    roles = F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("text")) for r in ("must", "should", "must_not")])
    texts = queries.select(F.col("query_id").alias("_query"), F.explode(roles).alias("_r")).select(
        F.struct("_query", "_r.role").alias("query_id"), "_r.text"
    )
    terms = query_terms(texts).select(
        F.col("query_id._query").alias("query_id"), F.col("query_id.role").alias("role"), "ord", "term", "maxdist", "n_terms"
    )
    needed = terms.where("role = 'must'").groupBy("query_id").agg(F.max("n_terms").alias("n_must"))
    hits = scored_hits(matches(index, terms, by_key=True), index)
    per_clause = (
        hits.select("query_id", "key", "role", "ord", "part")
        .groupBy("query_id", "key", "role", "ord")
        .agg(F.max("part").alias("part"))
    )
    counted = per_clause.groupBy("query_id", "key").agg(
        F.count_if(F.col("role") == "must").alias("n_found"),
        F.count_if(F.col("role") == "must_not").alias("n_banned"),
        F.round(F.sum(F.when(F.col("role") != "must_not", F.col("part"))), SCORE_DIGITS).alias("score"),
    )
    return (
        counted.join(small_side(needed), "query_id", "left")
        .where((F.col("n_banned") == 0) & (F.col("n_found") == F.coalesce("n_must", F.lit(0))) & F.col("score").isNotNull())
        .select("query_id", "key", "score")
    )


def phrase_hits(index: Index, terms: DataFrame) -> DataFrame:
    """``(query_id, key)`` of documents that hold the terms ``(query_id, ord, term, n_terms)`` of a query in a row.

    The rarest term of a query names the documents that can match; the postings of its other terms are picked by term and document, by broadcast
    where the documents are counted as few. So what is moved follows from the rarest term. Places are compared inside the row: an
    array per term, shifted by its place in the phrase, and their intersection. A query with a term that the index lacks finds nothing.
    """
    expanded, touched = surveyed(expand_terms(index, terms.withColumn("maxdist", F.lit(0))), index.buckets, "expanded")
    whole = expanded.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"), F.min(F.struct("df", "ord")).alias("_rare"))
    known = expanded.join(small_side(whole), "query_id").where("_n = n_terms")
    rare = known.where("ord = _rare.ord").drop("_n", "_rare")
    others = known.where("ord <> _rare.ord").select("query_id", "field", "term", "ord")
    first = postings_join(rare, index.postings, index.buckets)
    begins = F.transform("positions", lambda p: p - F.col("ord"))
    first = staged(first.select("query_id", "n_terms", "key", begins.alias("_begins")), "rarest")
    wanted = first.where("n_terms > 1").select("query_id", "key").join(small_side(others), "query_id").select("query_id", "key", "field", "term", "ord")
    met = within(index.postings, touched).select("field", "term", "key", "positions").join(small_side(wanted), ["field", "term", "key"])
    more = met.select("query_id", "key", F.transform("positions", lambda p: p - F.col("ord")).alias("_begins"))
    both = first.select("query_id", "key", "_begins", "n_terms").unionByName(more.withColumn("n_terms", F.lit(0)))
    rows = both.groupBy("query_id", "key").agg(F.collect_list("_begins").alias("_all"), F.max("n_terms").alias("n_terms"))
    shared = F.aggregate(F.slice("_all", 2, F.greatest(F.size("_all") - 1, F.lit(0))), F.get("_all", F.lit(0)), lambda acc, x: F.array_intersect(acc, x))
    return rows.where((F.size("_all") == F.col("n_terms")) & (F.size(shared) > 0)).select("query_id", "key")


def search_phrase(index: Index, queries: DataFrame) -> DataFrame:
    """Documents that hold the terms of a query in a row: ``(query_id, key)``."""
    return phrase_hits(index, query_terms(queries))


def _pattern_keys(pattern: Column) -> Column:
    """What a matching term must show: kind and up to four letters.

    The letters are the fixed head of the pattern, its fixed tail or the longest
    fixed run inside, whichever has most letters: a head of one letter would
    meet a large part of all words. A pattern without letters has the empty
    head, which every term shows.
    """
    head = F.left(F.regexp_extract(pattern, r"^[^*?]*", 0), F.lit(KEY_CHARS))
    tail = F.right(F.regexp_extract(pattern, r"[^*?]*$", 0), F.lit(KEY_CHARS))
    runs = F.transform(F.regexp_extract_all(pattern, F.lit(r"[^*?]+"), F.lit(0)), lambda r: F.left(r, F.lit(KEY_CHARS)))
    longest = F.coalesce(F.array_max(F.transform(runs, lambda r: F.struct(F.length(r).alias("n"), r.alias("run"))))["run"], F.lit(""))
    most = F.length(longest)
    return (
        F.when(F.length(head) >= most, F.struct(F.lit("head").alias("kind"), head.alias("letters")))
        .when(F.length(tail) >= most, F.struct(F.lit("tail").alias("kind"), tail.alias("letters")))
        .otherwise(F.struct(F.lit("inside").alias("kind"), longest.alias("letters")))
    )


def _shown(kind: str, size: int) -> Column:
    """The letters of this kind and size that a vocabulary term shows."""
    word = F.col("word")
    if kind == "head":
        return F.array(F.left(word, F.lit(size)))
    if kind == "tail":
        return F.array(F.right(word, F.lit(size)))
    spots = F.sequence(F.lit(1), F.greatest(F.length(word) - size + 1, F.lit(1)))
    return F.array_distinct(F.transform(spots, lambda s: F.substring(word, s, F.lit(size))))


def _tagged(kind: str, letters: Column) -> Column:
    return F.transform(letters, lambda each: F.struct(F.lit(kind).alias("kind"), each.alias("letters")))


def _matches(word: Column, pattern: Column) -> Column:
    """Whether the word matches; the plain shapes need no regular expression per row."""
    inner = F.replace(pattern, F.lit(ANY), F.lit(""))
    n_any = F.length(pattern) - F.length(inner)
    only_any = F.instr(pattern, ONE) == 0
    escaped = F.replace(pattern, F.lit("."), F.lit(r"\."))
    regex = F.replace(F.replace(escaped, F.lit(ANY), F.lit(".*")), F.lit(ONE), F.lit("."))
    return (
        F.when(only_any & (n_any == 1) & pattern.endswith(ANY), F.startswith(word, inner))
        .when(only_any & (n_any == 1) & pattern.startswith(ANY), F.endswith(word, inner))
        .when(only_any & (n_any == 2) & pattern.startswith(ANY) & pattern.endswith(ANY), F.contains(word, inner))
        .when((n_any == 0) & (F.length(word) != F.length(pattern)), F.lit(False))
        .otherwise(F.regexp_like(word, F.concat(F.lit("^"), regex, F.lit("$"))))
    )


def wildcard_terms(patterns: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Patterns ``(…, field, pattern)`` with the vocabulary terms they match, as ``term`` and ``df``."""
    keyed = patterns.withColumn("_key", _pattern_keys(F.col("pattern"))).select(*patterns.columns, "_key.*")
    # At most three kinds with five sizes each.
    shapes = [tuple(r) for r in keyed.select("kind", F.length("letters")).distinct().collect()]
    words = vocabulary.select("field", F.col("term").alias("word"), "df")
    shown = [_tagged(kind, _shown(kind, size)) for kind, size in sorted(shapes)]
    if not shown:
        return patterns.join(vocabulary.select("field", "term", "df"), "field").where("false")
    keys = words.select("*", F.explode(F.array_distinct(F.concat(*shown))).alias("_s")).select(*words.columns, "_s.*")
    return (
        keys.join(small_side(keyed), ["field", "kind", "letters"])
        .where(_matches(F.col("word"), F.col("pattern")))
        .select(*patterns.columns, F.col("word").alias("term"), "df")
    )


def _wanted_grams(pattern: Column) -> Column:
    """The grams every match of a pattern has: those of its fixed runs, with the signs of head and tail; the empty one if it has no letter."""
    framed = F.concat(F.lit(HEAD * (GRAM - 1)), pattern, F.lit(TAIL * (GRAM - 1)))
    runs = F.filter(F.regexp_extract_all(framed, F.lit(r"[^*?]+"), F.lit(0)), lambda r: ~r.isin(HEAD * (GRAM - 1), TAIL * (GRAM - 1)))
    cut = F.transform(
        runs,
        lambda r: F.when(F.length(r) < GRAM, F.array(r)).otherwise(
            F.transform(F.sequence(F.lit(1), F.greatest(F.length(r) - (GRAM - 1), F.lit(1))), lambda i: F.substring(r, i, GRAM))
        ),
    )
    found = F.array_distinct(F.flatten(cut))
    return F.when(F.size(found) > 0, found).otherwise(F.array(F.lit("")))


def _rarest_grams(index: Index, patterns: DataFrame) -> DataFrame:
    """(pattern, gram): of the grams a pattern wants, the one that the fewest words have; the empty one for a pattern without letters."""
    wanted = patterns.select("pattern").distinct().select("pattern", F.explode(_wanted_grams(F.col("pattern"))).alias("gram"))
    wanted = made_once(wanted, "wanted-grams")
    grams = wanted.where("gram <> ''").select("gram").distinct()
    sizes = staged(picked(index.grams, grams, "gram", index.buckets).groupBy("gram").agg(F.count(F.lit(1)).alias("n")), "gram-sizes")
    sized = wanted.join(small_side(sizes), "gram", "left").select("pattern", F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram").alias("g"))
    return made_once(sized.groupBy("pattern").agg(F.min("g").alias("g")).select("pattern", "g.gram"), "rarest-grams")


def _words_met(index: Index, patterns: DataFrame) -> DataFrame:
    """(pattern, term) of the words of an index; a word that several segments have may come several times.

    A pattern looks through the words that have its rarest gram, and itself decides on them. Of the grams only the buckets of those wanted are
    read. Patterns without letters meet all words, which are spread over all buckets.
    """
    wanted = _rarest_grams(index, patterns)
    lettered = picked(index.grams, wanted.where("gram <> ''"), "gram", index.buckets).select("pattern", "term")
    # The bucket of a word without letters in common is its own: the join is spread by it.
    spread = wanted.where("gram = ''").select("pattern", F.explode(F.sequence(F.lit(0), F.lit(index.buckets - 1))).alias("bucket"))
    anything = index.grams.where("gram = ''").select("bucket", "term").join(small_side(spread), "bucket").select("pattern", "term")
    return lettered.unionByName(anything).where(_matches(F.col("term"), F.col("pattern")))


def wildcard_lookup(index: Index, patterns: DataFrame) -> DataFrame:
    """``wildcard_terms`` through the grams filed with an index."""
    met = staged(_words_met(index, patterns).distinct(), "words-met")
    words = patterns.join(small_side(met), "pattern")
    local, touched = surveyed(words, index.buckets, "wildcard-terms")
    return within(index.vocabulary, touched).select("field", "term", "df").join(small_side(local, small=touched.small), ["field", "term"])


def wildcard_docs(index: Index, patterns: DataFrame) -> DataFrame:
    """``patterns(…, field, pattern)``, no two rows alike, with the ``key`` of every document that holds a match in the field, each once.

    A pattern that many queries have, and a document with many words of a pattern, cost no hit for each of them: a posting moves with the numbers of all
    patterns its term meets, and these are brought together by document before queries are told apart.
    """
    asked = made_once(patterns.select("field", "pattern").distinct(), "patterns-asked").withColumn("_at", F.monotonically_increasing_id())
    asked = made_once(number_rows(asked, "_at", "_number").select("field", "pattern", F.col("_number").cast("int").alias("_number")), "patterns-numbered")
    if index.grams is None:
        fields = [r[0] for r in asked.select("field").distinct().collect()]
        words = wildcard_terms(asked, index.vocabulary.where(F.col("field").isin(fields))).select("field", "term", "_number")
    else:
        words = _words_met(index, asked.select("pattern")).join(small_side(asked), "pattern").select("field", "term", "_number")
    numbered = staged(words.groupBy("field", "term").agg(F.collect_set("_number").alias("numbers")), "terms-met")
    _, touched = surveyed(numbered.select("field", "term"), index.buckets)
    filed = within(index.postings, touched).select("field", "term", "key")
    met = gathered(filed.join(small_side(numbered, NUMBERED_ROWS), ["field", "term"]).select("key", "numbers"))
    wanted = patterns.join(small_side(asked), ["field", "pattern"])
    return met.join(small_side(wanted), met.number == wanted._number).select(*patterns.columns, "key")


def search_prefix(index: Index, queries: DataFrame) -> DataFrame:
    """``queries(query_id, text)`` whose words may hold ``*`` and ``?``: ``(query_id, key)``.

    A document needs a match for every word. Words without a sign go through the analysis of documents, which drops some.
    """
    words = F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(_PATTERN), F.lit(0))
    words = F.filter(words, lambda w: w.rlike("[*?]") | is_kept(w, STOP_WORDS, MIN_LENGTH))
    patterns = with_field(
        queries.select("query_id", words.alias("_words"))
        .select("query_id", F.size("_words").alias("n_terms"), F.posexplode("_words").alias("ord", "pattern"))
    )
    patterns = made_once(patterns.distinct(), "patterns")
    # A query of one pattern meets a document once; only others are put together.
    per_query = Window.partitionBy("query_id", "n_terms")
    counted = patterns.withColumn("_alone", (F.col("n_terms") == 1) & (F.count(F.lit(1)).over(per_query) == 1))
    some, alone = counted.agg(F.coalesce(F.bool_or(~F.col("_alone")), F.lit(False)), F.coalesce(F.bool_or("_alone"), F.lit(True))).first()
    hits = wildcard_docs(index, counted)
    if not some:
        return hits.select("query_id", "key")
    if not alone:
        return complete(hits)
    return hits.where("_alone").select("query_id", "key").unionByName(complete(hits.where("NOT _alone")))


def search_field(index: Index, queries: DataFrame) -> DataFrame:
    """``queries(query_id, field, text)``: ``(query_id, key)`` of documents with all terms in that field.

    The key is one word: it matches as a whole.
    """
    fields = queries.select(F.struct("query_id", "field").alias("query_id"), "text").where("query_id.field <> 'key'")
    terms = query_terms(fields).select(
        F.col("query_id.query_id").alias("query_id"), F.col("query_id.field").alias("field"), "ord", "term",
        F.lit(0).alias("maxdist"), "n_terms",
    )
    by_terms = complete_parts(*parted_matches(index, terms))
    wanted = queries.where("field = 'key'").select("query_id", F.col("text").alias("key"))
    return by_terms.unionByName(index.docs.select("key").join(wanted, "key").select("query_id", "key"))
