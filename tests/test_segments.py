"""Indexes that grow, blocks that are not read, lookups through filed parts of words, query strings; stores with deltas."""

import fnmatch
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_search import WORDS, bm25, composite, docs, edits, queries, terms_of

from pageloom.operators import joins, upsert
from pageloom.plans import search as plans
from pageloom.plans.search import search_batch
from pageloom.schema import STORE
from pageloom.search import analysis, blocks, grammar, index, match, modes, rank, segments
from pageloom.session import scratch_path
from pageloom.sources import filters, fs, manifest
from pageloom.sources import store as store_source


def made(n, seed=11):
    rng = random.Random(seed)
    body = lambda i: " ".join(rng.choices(WORDS, k=rng.randint(1, 30))) + " common" * rng.randint(1, 9) + (" rare" if i % 97 == 5 else "")
    return [(f"k{i:04d}", rng.choice(WORDS), f"https://x.org/{i}", body(i), rng.choice(["", "data park"])) for i in range(n)]


ENTRIES = made(400)


@pytest.fixture(scope="module")
def one(spark):
    """All documents in one segment, in blocks of eight."""
    old, segments.BLOCK_BITS = segments.BLOCK_BITS, 3
    yield index.build_index(docs(spark, ENTRIES), scratch_path(spark, "index"), buckets=4)
    segments.BLOCK_BITS = old


@pytest.fixture(scope="module")
def grown(spark, one):
    """The same documents added in parts; parts overlap, so most of what comes is there already."""
    path = scratch_path(spark, "index")
    for k, upto in enumerate((150, 160, 175, 190, 205, 400)):
        segments.index_append(docs(spark, ENTRIES[:upto]), path, name=f"batch-{k}", merge=k != 5, buckets=4)
    return path


def posted(idx):
    return rows(idx.postings.withColumn("positions", F.array_join(F.col("positions").cast("array<string>"), ",")), "field", "term", "key", "tf", "dl", "positions")


def test_an_index_that_grew_is_the_one_built_at_once(spark, one, grown):
    idx = segments.read_index(spark, grown)
    _, state = manifest.newest(spark, grown)
    # 150 documents, the four small parts merged into one, and the rest.
    assert sorted(s["n_docs"] for s in state["segments"]) == [55, 150, 195]
    assert posted(idx) == posted(one)
    assert rows(idx.vocabulary, "field", "term", "df") == rows(one.vocabulary, "field", "term", "df")
    assert rows(idx.corpus) == rows(one.corpus) and rows(idx.docs) == rows(one.docs)
    asked = analysis.query_terms(queries(spark, ["data", "rare", "hot common"]))
    assert rows(rank.bm25_score(match.matches(idx, asked), idx)) == rows(rank.bm25_score(match.matches(one, asked), one))
    blocks_of = idx.postings.groupBy("seg", "block").agg(F.countDistinct("key").alias("n"))
    assert blocks_of.agg(F.max("n")).first()[0] <= 8


def test_a_batch_that_comes_again_changes_nothing(spark, grown):
    before = manifest.newest(spark, grown)
    segments.index_append(docs(spark, [("other", "t", "u", "c", "s")]), grown, name="batch-3")
    segments.index_append(docs(spark, ENTRIES[:30]), grown)
    assert manifest.newest(spark, grown) == before


def test_only_new_documents_are_written(spark, grown):
    folders = set(fs.subfolders(spark, f"{grown}/docs"))
    idx = segments.index_append(docs(spark, [*ENTRIES[:50], ("new", "fresh", "u", "words here", "")]), grown, merge=False)
    (added,) = set(fs.subfolders(spark, f"{grown}/docs")) - folders
    assert spark.read.parquet(f"{grown}/docs/{added}").count() == 1
    assert idx.vocabulary.where("term = 'fresh' AND field = 'title'").count() == 1 and idx.docs.count() == 401
    # What a crash leaves behind is in no manifest.
    segments.write_segment(docs(spark, [("lost", "t", "u", "lost words", "")]), grown, 4)
    assert segments.read_index(spark, grown).docs.count() == 401
    number, state = manifest.newest(spark, grown)
    with pytest.raises(RuntimeError):
        manifest.commit(spark, grown, number, state)


@pytest.mark.parametrize("which", ["one", "grown"])
def test_pages_from_needed_blocks_are_those_of_full_scoring(spark, one, grown, which):
    idx = one if which == "one" else segments.read_index(spark, grown)
    texts = ["common", "data", "rare", "common data", "rare common", "dat~1", "common~1 rare", "nothing", "", "common common", "park spark hot"]
    asked = queries(spark, texts).withColumns({"page": F.when(F.col("query_id") % 3 == 1, 4).otherwise(1), "page_size": F.lit(7)})
    plain = index.Index(idx.docs, idx.postings, idx.vocabulary, idx.corpus, idx.buckets)
    got, want = search_batch(idx, asked), search_batch(plain, asked)
    assert rows(got[1]) == rows(want[1])
    assert rows(got[0], "query_id", "rank", "key", "score") == rows(want[0], "query_id", "rank", "key", "score")
    assert got[0].count() > 30


def test_blocks_of_a_word_that_is_everywhere_are_skipped(spark, one):
    asked = queries(spark, ["common", "common rare"]).withColumns({"page": F.lit(1), "page_size": F.lit(5)})
    expanded, touched = match.surveyed(match.expand_terms(one, analysis.query_terms(asked)), one.buckets)
    hits = blocks.impact_hits(one, expanded, touched)
    depths = spark.createDataFrame([(0, 5)], "query_id long, depth long")
    top = blocks.best_blocks(hits.where("query_id = 0"), depths)
    shared = blocks.shared_blocks(hits.where("query_id = 1"))
    everywhere = hits.where("query_id = 0").select("seg", "block").distinct().count()
    assert everywhere == 50 and 1 <= top.count() <= 12
    # Five documents have the rare word, so at most five blocks of the common one are read.
    assert shared.where("term = 'common'").count() <= 5
    read = blocks.postings_in(one, expanded, shared, touched)
    assert read.where("term = 'common'").count() <= 40 < expanded.where("term = 'common' AND query_id = 1").first()["df"]
    # No block that holds one of the best documents is among the skipped.
    best = sorted(((-s, k) for k, s in bm25(ENTRIES, "common").items()))[:5]
    kept = one.postings.join(top, ["field", "term", "seg", "block"]).select("key")
    assert {k for _, k in best} <= {r["key"] for r in kept.collect()}


def test_bounds_hold_for_every_document(spark, one):
    expanded, touched = match.surveyed(match.expand_terms(one, analysis.query_terms(queries(spark, WORDS))), one.buckets)
    hits = blocks.impact_hits(one, expanded, touched).groupBy(*blocks.PLACE).agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))
    scored = rank.scored_hits(match.postings_join(expanded, one.postings, one.buckets), one)
    per = scored.groupBy(*blocks.PLACE).agg(F.min("part").alias("least"), F.max("part").alias("most"), F.count(F.lit(1)).alias("docs"))
    both = hits.join(per, blocks.PLACE)
    assert both.where("n <> docs OR low > round(least, 6) OR abs(high - most) > 1e-6").count() == 0 and both.count() > 500


@pytest.mark.parametrize("maxdist", [1, 2])
def test_fuzzy_lookup_finds_all_near_terms(spark, maxdist):
    rng = random.Random(maxdist)
    words = sorted({"".join(rng.choices("abü", k=rng.randint(2, 12))) for _ in range(300)})
    idx = index.build_index(docs(spark, [(f"k{i}", "", "", w, "") for i, w in enumerate(words)]), scratch_path(spark, "index"), buckets=4, stop_words=())
    asked = ["".join(rng.choices("abü", k=rng.randint(1, 12))) for _ in range(40)]
    asked += [w[1:] for w in words[:20]] + [w + "a" for w in words[:20]]
    terms = spark.createDataFrame([(i, 0, w, maxdist, 1) for i, w in enumerate(asked)], "query_id long, ord int, term string, maxdist int, n_terms int")
    expected = [(i, w) for i, a in enumerate(asked) for w in words if edits(a, w) <= maxdist]
    found = match.fuzzy_lookup(idx, match.with_field(terms))
    assert rows(found, "query_id", "term") == sorted(expected, key=repr)
    assert "Generate explode" not in idx.vocabulary._jdf.queryExecution().optimizedPlan().toString()


def test_wildcards_through_grams(spark, one):
    patterns = ["d*", "*ark", "p?thon*", "*a?e", "b?r?", "*yth*", "a.*", "*", "??", "?*a", "zz*", "*t*o*", "*ü*", "data", "????????????", "*a", "a?"]
    asked = match.with_field(spark.createDataFrame([(i, p) for i, p in enumerate(patterns)], "query_id long, pattern string"))
    words = {t for e in ENTRIES for t in terms_of(composite(e))}
    expected = sorted(((i, w) for i, p in enumerate(patterns) for w in words if fnmatch.fnmatchcase(w, p)), key=repr)
    assert rows(modes.wildcard_lookup(one, asked), "query_id", "term") == expected
    vocabulary = one.vocabulary.where("field = 'composite_text'")
    assert rows(modes.wildcard_terms(asked, vocabulary), "query_id", "term") == expected


def test_phrases_begin_with_their_rarest_term(spark, one):
    texts = ["common rare", "data park", "common common", "rare", "missing data", "data park common", "hot common common"]
    held = {e[0]: " " + " ".join(terms_of(composite(e))) + " " for e in ENTRIES}
    expected = [(i, k) for i, t in enumerate(texts) for k, j in held.items() if f" {t} " in j]
    assert rows(modes.search_phrase(one, queries(spark, texts)), "query_id", "key") == sorted(expected, key=repr)


# Query strings


def leaf(entry, clause):
    field = {"title": entry[1], "url": entry[2], "content": entry[3], "summary": entry[4], "composite_text": composite(entry)}
    if clause["field"] == "key":
        return entry[0] == clause["text"]
    have = terms_of(field[clause["field"]])
    if clause["kind"] == "wild":
        return any(fnmatch.fnmatchcase(t, clause["text"].lower()) for t in have)
    word, _, k = clause["text"].partition("~") if clause["kind"] == "word" else (clause["text"], "", "")
    wanted = terms_of(word)
    if not wanted:
        return None
    if "~" in clause["text"] and clause["kind"] == "word":
        return any(edits(wanted[0], t) <= int(k or 1) for t in have)
    return any(have[i : i + len(wanted)] == wanted for i in range(len(have)))


def holds(entry, clauses, tree):
    """(whether the tree holds, whether a clause that counts is met); a clause of nothing is as if not written."""
    stack = []
    for node in tree:
        if node["op"] == "clause":
            stack.append(leaf(entry, clauses[node["clause"]]))
        elif node["op"] == "not":
            top = stack.pop()
            stack.append(None if top is None else not top)
        else:
            b, a = stack.pop(), stack.pop()
            both = [x for x in (a, b) if x is not None]
            stack.append(None if not both else all(both) if node["op"] == "and" else any(both))
    met = any(leaf(entry, c) for c in clauses if not c["excluded"])
    return bool(stack and stack[-1]) and met


STRINGS = [
    "data", "data AND park", "data OR rare", "rare NOT data", "(rare OR hot) spark", "NOT (data OR park) common", "NOT data", '"data park"', '"data park" OR rare', "dat~1 rare",
    "p?thon* rare", "title:data park", "title:(data) park", "url:x.org rare", "key:k0005", "key:k0005 OR rare", "the data", "rare AND the", "NOT the rare", "((data rare", "data) rare",
    "AND OR data", "data OR", "data NOT", '"unclosed phrase', "", "   ", "()", "NOT NOT rare", "rare (data OR (park NOT (spark OR hot)))", "nofield:data rare", "a.b OR xy AND yx", "DATA Rare", "*",
    "spark AND NOT spark", "rare OR NOT common", '"the"', "d* -- rare", "(data AND park) OR (rare AND (uber OR über))",
]


def test_query_strings(spark, one):
    asked = queries(spark, [*STRINGS, None])
    got = rows(grammar.search_query(one, asked), "query_id", "key")
    expected = []
    for i, text in enumerate(STRINGS):
        clauses, tree = grammar.parse(text)
        expected += [(i, e[0]) for e in ENTRIES if holds(e, clauses, tree)]
    assert got == sorted(expected, key=repr)


def test_parser():
    def postfix(text):
        clauses, tree = grammar.parse(text)
        return " ".join(n["op"] if n["op"] != "clause" else clauses[n["clause"]]["text"] for n in tree)

    assert postfix("a1 AND b1 OR c1 d1") == "a1 b1 and c1 d1 and or"
    assert postfix("NOT a1 (b1 OR NOT c1)") == "a1 not b1 c1 not or and"
    assert postfix("NOT (a1 OR b1)") == "a1 b1 or not"
    assert postfix(")) a1 OR OR (( b1 AND") == "a1 b1 or"
    assert grammar.parse('title:"x y"~2 url:z*')[0] == [
        {"clause": 0, "kind": "phrase", "field": "title", "text": "x y", "excluded": False},
        {"clause": 1, "kind": "wild", "field": "url", "text": "z*", "excluded": False},
    ]
    assert [c["excluded"] for c in grammar.parse("NOT (a1 NOT b1) c1")[0]] == [True, False, False]
    rng = random.Random(9)
    for _ in range(2000):
        text = " ".join(rng.choice(["a1", "b*", '"c d"', "AND", "OR", "NOT", "(", ")", '"', "~", ":", "title:x1"]) for _ in range(rng.randrange(12)))
        clauses, tree = grammar.parse(text)
        depth = 0
        for node in tree:  # the array is a tree: every operator finds its operands
            depth += 1 if node["op"] == "clause" else 0 if node["op"] == "not" else -1
            assert depth >= 1
        assert depth == (1 if tree else 0) and len(clauses) == sum(n["op"] == "clause" for n in tree)


# Stores


def stored(spark, keys, name="n"):
    return upsert.to_store_rows(spark.createDataFrame([(k, f"https://h.org/{k}", f"{name}{k}") for k in keys], "key long, url string, name string"))


def test_deltas_are_a_rewrite(spark):
    path = scratch_path(spark, "store")
    store_source.store_replace(stored(spark, range(1, 3001)), path)
    kept = stored(spark, range(1, 3001))
    for turn in range(4):
        urls = [(p, f"https://h.org/{(turn * 40 + p * 7) % 3200 + 1}", f"turn {turn} {p}") for p in range(50)]
        batch = spark.createDataFrame([*urls, (99, " ", "blank"), (50, urls[0][1], "again")], "pos long, url string, name string")
        kept = spark.createDataFrame(upsert.store_upsert(kept, batch).collect(), STORE)
        upsert.upsert_into(batch, path)
        if turn == 1:
            upsert.upsert_into(batch, path)  # a replay
        assert rows(store_source.store_scan(spark, path), "key", "url", "name") == rows(kept, "key", "url", "name")
    deltas = fs.subfolders(spark, f"{path}/delta")
    assert max(spark.read.parquet(f"{path}/delta/{d}").count() for d in deltas) == 50
    # Folding files all rows by bucket the first time, later only what was touched.
    store_source.store_fold(spark, path, buckets=16)
    assert rows(store_source.store_scan(spark, path), "key", "url", "name") == rows(kept, "key", "url", "name")
    assert store_source.store_fold(spark, path) is None
    before = {s["path"] for s in manifest.newest(spark, path)[1]["segments"]}
    few = spark.createDataFrame([(1, "https://h.org/5", "five"), (2, "https://h.org/none", "none")], "pos long, url string, name string")
    upsert.upsert_into(few, path)
    kept = spark.createDataFrame(upsert.store_upsert(kept, few).collect(), STORE)
    store_source.store_fold(spark, path)
    after = {s["path"] for s in manifest.newest(spark, path)[1]["segments"]}
    assert len(before) == len(after) == 16 and 1 <= len(after - before) <= 2
    assert rows(store_source.store_scan(spark, path), "key", "url", "name") == rows(kept, "key", "url", "name")
    assert store_source.store_compact(spark, path) and rows(store_source.store_scan(spark, path), "key", "url", "name") == rows(kept, "key", "url", "name")


def test_appends_beside_deltas(spark):
    path = scratch_path(spark, "store")
    store_source.store_append(stored(spark, range(1, 11)), path, "a")
    upsert.upsert_into(spark.createDataFrame([(1, "https://h.org/3", "three"), (2, "https://h.org/x", "x")], "pos long, url string, name string"), path)
    assert store_source.last_key(spark, path) == 11
    store_source.store_append(stored(spark, range(12, 15)), path, "b")
    store_source.store_append(stored(spark, range(12, 16)), path, "b")
    found = rows(store_source.store_scan(spark, path), "key", "name")
    assert len(found) == 15 and (3, "three") in found and (11, "x") in found
    store_source.store_fold(spark, path, buckets=4)
    assert rows(store_source.store_scan(spark, path), "key", "name") == found
    assert store_source.segment_committed(spark, path, "a")


def test_failures_of_a_run_that_starts_again(spark):
    from pageloom.sources import failures

    path = scratch_path(spark, "failed")
    run = spark.createDataFrame([(5, "u5", "t", "r", "x"), (2, "u2", "t", "r", "x")], "pos long, url string, title string, reason string, timestamp string")
    for _ in range(2):
        failures.failed_append(run, path, "run-1")
    failures.failed_append(run.where("pos = 2"), path, "run-2")
    assert rows(failures.failed_scan(spark, path, keyed=True), "key", "url") == [(1, "u2"), (2, "u5"), (3, "u2")]


def test_needed_scores_leave_out_rows(spark, one):
    asked = queries(spark, ["common"]).withColumns({"page": F.lit(1), "page_size": F.lit(3)})
    valid = rank.request_validate(asked, "clamp")
    expanded, touched = match.surveyed(match.expand_terms(one, analysis.query_terms(valid)), one.buckets)
    scored, totals = plans.needed_scores(one, expanded, touched, valid)
    assert totals.first()["total_results"] == 400 and 3 <= scored.count() <= 120


def opened(df):
    return {f.split("/seg=")[1][0] for f in df.inputFiles() if "/seg=" in f}


def test_segments_that_cannot_concern_a_batch_are_not_opened(spark):
    path = scratch_path(spark, "store")
    for name, keys in {"a": range(1, 1001), "b": range(1001, 2001), "c": range(2001, 3001), "e": []}.items():
        told = upsert.to_store_rows(stored(spark, keys).drop("content_hash").withColumn("content", F.expr("IF(key % 10 = 0, NULL, concat('text ', key))")))
        store_source.store_append(told, path, name)
    whole = store_source.store_scan(spark, path)
    batch = spark.createDataFrame([(1, "https://h.org/1500", "text 7"), (2, "https://h.org/new", None), (3, None, "nowhere")], "pos long, url string, content string")
    batch = joins.with_content_hash(joins.with_url_hash(batch))
    near = {kind: store_source.store_near(spark, path, batch, kind) for kind in filters.KINDS}
    assert opened(near["url_hash"]) == {"b"} and opened(near["content_hash"]) == {"a"} and opened(whole) >= {"a", "b", "c"}
    for kind, antijoin in {"url_hash": joins.incremental_url_antijoin, "content_hash": joins.content_antijoin}.items():
        assert rows(antijoin(batch, near[kind]), "pos") == rows(antijoin(batch, whole), "pos")
    # Nothing known, nothing asked.
    assert opened(store_source.store_near(spark, path, batch.where("pos = 2"), "url_hash")) == set()
    assert store_source.store_near(spark, path, batch.limit(0), "content_hash").count() == 0
    # A replaced content is gone, its successor found in the delta.
    upsert.upsert_into(spark.createDataFrame([(1, "https://h.org/7", "text 7b")], "pos long, url string, content string"), path)
    after = joins.with_content_hash(spark.createDataFrame([(1, "text 7"), (2, "text 7b"), (3, "text 8")], "pos long, content string"))
    assert rows(joins.content_antijoin(after, store_source.store_near(spark, path, after, "content_hash")), "pos") == [(1,)]
    # Folded buckets have filters too, and segments of before there were any are always opened.
    store_source.store_fold(spark, path, buckets=16)
    one = store_source.store_near(spark, path, batch.where("pos = 1"), "url_hash")
    assert len({f.rsplit("/", 1)[0] for f in one.inputFiles()}) == 1 and one.where("key = 1500").count() == 1
    number, state = manifest.newest(spark, path)
    bare = [{k: v for k, v in s.items() if k not in ("filter", "bits")} for s in state["segments"]]
    manifest.commit(spark, path, number + 1, {**state, "segments": bare})
    assert store_source.store_near(spark, path, batch, "url_hash").count() == 3000


def test_filters_know_all_their_hashes_and_few_others(spark):
    path, n = scratch_path(spark, "store"), 20_000
    rows_in = spark.range(n).select(F.sha2(F.col("id").cast("string"), 256).alias("url_hash"))
    told = rows_in.select(F.lit("s").alias("segment"), F.lit(filters.bits_for(n)).alias("bits"), "url_hash", F.lit(None).cast("string").alias("content_hash"))
    filters.filters_write(told, f"{path}/f")
    segment = {"path": "s", "filter": "f", "bits": filters.bits_for(n)}

    def passes(ids):
        asked = spark.createDataFrame([(str(i),) for i in ids], "id string").select(F.sha2("id", 256).alias("url_hash"))
        return filters.segments_with(spark, path, [segment], asked, "url_hash")

    assert all(passes([i]) == [segment] for i in (0, 77, n - 1))
    assert sum(bool(passes(range(n + 500 * i, n + 500 * (i + 1)))) for i in range(6)) <= 1
    assert passes(range(filters.LOOKED_UP + 1)) is None
