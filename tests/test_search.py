import fnmatch
import math
import random
import re
from collections import Counter

import pytest
import regex
from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators.summaries import prompt_build, stored_summaries, summary_apply, summary_backlog, summary_run_counts
from pageloom.operators.upsert import to_store_rows
from pageloom.plans.search import search_batch, search_one
from pageloom.plans.summarise import summarise_store
from pageloom.search import analysis, index, match, modes, rank, results
from pageloom.session import scratch_path
from pageloom.sources import store as store_source

DOCS = "pos long, key string, title string, url string, content string, summary string"


def docs(spark, entries):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(entries)], DOCS)
    return df.withColumn("composite_text", F.concat_ws(" ", "title", "content", "summary"))


def build(spark, entries, **options):
    return index.build_index(docs(spark, entries), scratch_path(spark, "index"), buckets=4, **options)


@pytest.fixture(scope="module")
def small(spark):
    return build(
        spark,
        [
            ("key1", "Example", "https://example.com", "Content of example", "Summary of example"),
            ("key2", "Google", "https://google.com", "Search engine", "Google search"),
            ("key3", "Python", "https://python.org", "Python programming", "Python lang"),
        ],
    )


def test_small_corpus(small):
    found, pagination = search_one(small, "Example")
    assert [r["title"] for r in found.collect()] == ["Example"]
    assert search_one(small, "Pythn~1")[0].count() == 1
    found, pagination = search_one(small, "Python", 1, 1)
    assert found.count() == 1
    assert pagination.first().asDict() == {
        "query_id": 0, "page": 1, "page_size": 1, "total_results": 1, "total_pages": 1, "has_next": False, "has_prev": False
    }
    first = found.first()
    assert first["full_record"]["summary"] == "Python lang" and first["snippet"] == "<b>Python</b> <b>Python</b> programming <b>Python</b> lang"
    assert search_one(small, "nothing here")[1].first()["total_pages"] == 0
    assert search_one(small, "")[0].count() == 0


def test_second_corpus(spark):
    idx = build(
        spark,
        [
            ("u1", "Python Programming", "u1", "Python is a programming language.", "Official Python website."),
            ("u2", "GitHub", "u2", "GitHub is a code hosting platform.", "Where code lives."),
        ],
    )
    assert search_one(idx, "python")[0].first()["title"] == "Python Programming"
    assert search_one(idx, "code")[0].first()["title"] == "GitHub"


def test_prepare_and_update(spark):
    store = spark.createDataFrame(
        [(1, "u", "name", " ", "guid1", "N/A", "a" * 10005, None, None), (2, "v", "name", None, "N/A", "N/A", None, "about", " s ")],
        "key long, url string, name string, title string, guid string, id string, content string, description string, summary string",
    )
    assert index.search_doc_prepare(store).where("key = 'guid1'").first()["content"] == "a" * 10005 + "\n\n"
    found = {r["key"]: r for r in index.search_doc_prepare(store, max_chars=10_000).collect()}
    assert len(found["guid1"]["content"]) == 10003 and found["guid1"]["content"].endswith("a...")
    assert found["v"]["content"] == "\n\nabout" and found["v"]["title"] == "name" and found["v"]["summary"] == "s"

    many = docs(spark, [(f"k{i % 2005}", f"title{i}", "u", "text", "") for i in range(2010)])
    idx = index.build_index(many, scratch_path(spark, "index"), buckets=4)
    assert index.index_scan_count(idx).first()[0] == 2005
    assert idx.docs.where("key = 'k3'").first()["title"] == "title3"
    updated = index.index_update(idx, docs(spark, [("k1", "changed", "u", "x", ""), ("new", "fresh words", "u", "text", "")]))
    assert updated.docs.count() == 2006 and updated.docs.where("title = 'changed'").count() == 0
    assert updated.vocabulary.where("field = 'content' AND term = 'text'").first()["df"] == 2006
    assert updated.corpus.where("field = 'title'").first()["n_docs"] == 2006
    path = scratch_path(spark, "index")
    index.write_index(updated, path)
    assert search_one(index.read_index(spark, path), "fresh")[1].first()["total_results"] == 1


WORDS = "data date dates gate late plate python pythons spark sparks park bark barn born corn über uber a.b ab abc abd xy yx".split()


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    entries = []
    for i in range(300):
        body = " ".join(rng.choices(WORDS, k=rng.randint(1, 30)))
        entries.append((f"k{i:03d}", rng.choice(WORDS), f"https://x.org/{i}", body + (" hot" if i % 3 else ""), rng.choice(["", "data park"])))
    return entries, build(spark, entries)


def terms_of(text):
    found = re.findall(r"[^\W]+(?:\.[^\W]+)*", text.lower())
    return [t for t in found if len(t) >= 2 and t not in analysis.STOP_WORDS]


def composite(entry):
    return f"{entry[1]} {entry[3]} {entry[4]}"


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, previous = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(previous[j] + 1, row[-1] + 1, previous[j - 1] + (x != y)))
    return row[-1]


def bm25(entries, term):
    texts = {e[0]: Counter(terms_of(composite(e))) for e in entries}
    average = sum(sum(c.values()) for c in texts.values()) / len(texts)
    holding = {k: c for k, c in texts.items() if c[term]}
    idf = math.log(len(texts) / (len(holding) + 1)) + 1
    return {k: idf * c[term] * 2.2 / (c[term] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) for k, c in holding.items()}


def queries(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "query_id long, text string")


def test_postings(corpus):
    entries, idx = corpus
    expected = []
    for e in entries:
        for field, text in (("title", e[1]), ("url", e[2]), ("content", e[3]), ("summary", e[4]), ("composite_text", composite(e))):
            terms = terms_of(text)
            expected += [(field, t, e[0], len(terms), tuple(i for i, u in enumerate(terms) if u == t)) for t in set(terms)]
    found = [(r["field"], r["term"], r["key"], r["dl"], tuple(r["positions"])) for r in idx.postings.collect()]
    assert sorted(found) == sorted(expected)


def test_query_terms(spark):
    found = rows(analysis.query_terms(queries(spark, ["The machine learning~1 ~ a.b~ x~2 of vision~3", None, "state-of art~"])), "query_id", "ord", "term", "maxdist", "n_terms")
    assert found == [
        (0, 0, "machine", 0, 4), (0, 1, "learning", 1, 4), (0, 2, "a.b", 1, 4), (0, 3, "vision", 3, 4), (2, 0, "state", 0, 2), (2, 1, "art", 1, 2),
    ]


@pytest.mark.parametrize("maxdist", [1, 2, 3])
def test_fuzzy_join_finds_all_near_terms(spark, maxdist):
    rng = random.Random(maxdist)
    made = {"".join(rng.choices("abü", k=rng.randint(1, 9))) for _ in range(250)}
    vocabulary = spark.createDataFrame([(w, 1) for w in made], "term string, df long")
    asked = ["".join(rng.choices("abü", k=rng.randint(1, 9))) for _ in range(40)]
    terms = spark.createDataFrame([(i, 0, w, maxdist, 1) for i, w in enumerate(asked)], "query_id long, ord int, term string, maxdist int, n_terms int")
    expected = [(i, w) for i, a in enumerate(asked) for w in made if edits(a, w) <= maxdist]
    assert rows(match.fuzzy_term_join(terms, vocabulary), "query_id", "term") == sorted(expected, key=repr)


def test_exact_and_fuzzy_search(spark, corpus):
    entries, idx = corpus
    texts = ["data", "data spark", "hot python park", "missing data", "dat~1 spark", "purk~ barn~1", "sparky~2"]
    asked = queries(spark, texts)

    def brute(text, fuzzy):
        words = [w.split("~") for w in text.split()]
        for e in entries:
            have = set(terms_of(composite(e)))
            near = [int((w[1] or 1)) if fuzzy and len(w) > 1 else 0 for w in words]
            if all(any(edits(w[0], t) <= k for t in have) for w, k in zip(words, near)):
                yield e[0]

    for search, fuzzy in ((match.search_exact, False), (match.search_fuzzy, True)):
        assert rows(search(idx, asked), "query_id", "key") == sorted(((i, k) for i, t in enumerate(texts) for k in brute(t, fuzzy)), key=repr)


def test_bm25_and_pages(spark, corpus):
    entries, idx = corpus
    texts = ["hot", "data", "uber", "nothing"]
    requests = queries(spark, texts).withColumns({"page": F.when(F.col("query_id") == 0, 3).otherwise(50), "page_size": F.lit(9)})
    scored = rank.bm25_score(match.matches(idx, analysis.query_terms(requests)), idx).cache()
    expected = {i: bm25(entries, t) for i, t in enumerate(texts)}
    found = {(r["query_id"], r["key"]): r["score"] for r in scored.collect()}
    assert set(found) == {(i, k) for i, e in expected.items() for k in e}
    assert all(abs(s - expected[i][k]) < 1e-5 for (i, k), s in found.items())
    pagination = rank.pagination_meta(rank.search_total_hits(scored), requests)
    shallow = rows(rank.search_page(scored, pagination))
    assert shallow == rows(rank.search_page(scored, pagination, shallow_rows=0))
    by_query = {i: sorted(((-found[i, k], k) for k in e)) for i, e in expected.items()}
    for i, ranked in by_query.items():
        pages = max(1, math.ceil(len(ranked) / 9))
        page = min(3 if i == 0 else 50, pages)
        wanted = [(i, n + 1, k, -s) for n, (s, k) in enumerate(ranked)][(page - 1) * 9 : page * 9]
        assert [r for r in shallow if r[0] == i] == sorted(wanted, key=repr)


def test_many_terms_join_by_salt(spark, corpus, monkeypatch):
    _, idx = corpus
    asked = queries(spark, [" ".join(WORDS[:6]), "hot", "hot data"])
    expanded = match.expand_terms(idx, analysis.query_terms(asked))
    monkeypatch.setattr(match, "HOT_POSTINGS", 50)
    few = rows(match.postings_join(expanded, idx.postings, idx.buckets), "query_id", "ord", "term", "key", "tf", "df")
    many = rows(match.postings_join(expanded, idx.postings, idx.buckets, broadcast_rows=0), "query_id", "ord", "term", "key", "tf", "df")
    assert few == many and len(few) > 500


def test_wildcards(spark, corpus):
    entries, idx = corpus
    texts = ["d*", "*ark", "p?thon*", "*a?e", "b?r?", "*yth*", "a.*", "*", "sp* *ata", "zz*", "*t*o*"]
    expected = []
    for i, text in enumerate(texts):
        for e in entries:
            have = set(terms_of(composite(e)))
            if all(any(fnmatch.fnmatchcase(t, p) for t in have) for p in text.split()):
                expected.append((i, e[0]))
    assert rows(modes.search_prefix(idx, queries(spark, texts)), "query_id", "key") == sorted(expected, key=repr)


def test_phrases(spark, corpus):
    entries, idx = corpus
    joined = {e[0]: " " + " ".join(terms_of(composite(e))) + " " for e in entries}
    texts = ["data park", "spark data", "data data", "the data of park", "born corn barn", "hot"]
    expected = [(i, k) for i, t in enumerate(texts) for k, j in joined.items() if " " + " ".join(terms_of(t)) + " " in j]
    assert rows(modes.search_phrase(idx, queries(spark, texts)), "query_id", "key") == sorted(expected, key=repr)


def test_boolean_and_field(spark, corpus):
    entries, idx = corpus
    clauses = [("data", "", "hot"), ("", "uber born", "data"), ("data park", "spark", ""), (None, None, "data")]
    asked = spark.createDataFrame([(i, *c) for i, c in enumerate(clauses)], "query_id long, must string, should string, must_not string")
    expected = []
    for i, (must, should, must_not) in enumerate(clauses):
        for e in entries:
            have = set(terms_of(composite(e)))
            m, s, n = (set((c or "").split()) for c in (must, should, must_not))
            if m <= have and not n & have and (m or s & have):
                expected.append((i, e[0]))
    assert rows(modes.search_boolean(idx, asked), "query_id", "key") == sorted(expected, key=repr)

    fields = spark.createDataFrame([(0, "title", "data"), (1, "summary", "park"), (2, "key", "k007"), (3, "url", "x.org 12"), (4, "content", "data hot")], "query_id long, field string, text string")
    place = {"title": 1, "url": 2, "content": 3, "summary": 4}
    expected = [(2, "k007")]
    for i, field, text in [(0, "title", "data"), (1, "summary", "park"), (3, "url", "x.org 12"), (4, "content", "data hot")]:
        expected += [(i, e[0]) for e in entries if set(text.split()) <= set(terms_of(e[place[field]]))]
    assert rows(modes.search_field(idx, fields), "query_id", "key") == sorted(expected, key=repr)


def test_snippets(spark):
    text = "Content " * 50
    page = spark.createDataFrame([(0, 1, text), (1, 1, "x " * 60 + "Deep, Data here" + " y" * 60)], "query_id long, rank long, composite_text string")
    terms = spark.createDataFrame([(0, "absent"), (1, "data"), (1, "here")], "query_id long, term string")
    found = dict(rows(results.search_snippet(page, terms, context=4), "query_id", "snippet"))
    assert found[0] == text[:200] + "..." and len(found[0]) == 203
    # Four words or gaps on each side of the first hit.
    assert found[1] == "x Deep, <b>Data</b> <b>here</b> y"


def test_snippets_of_widely_expanded_queries(spark):
    page = spark.createDataFrame([(0, 1, "one Two three"), (0, 2, "nothing"), (1, 1, "two")], "query_id long, rank long, composite_text string")
    terms = spark.createDataFrame([(0, "two"), (0, "two"), (0, "four"), (1, "one")], "query_id long, term string")
    few, many = (rows(results.search_snippet(page, terms, small=small), "query_id", "rank", "snippet") for small in (True, False))
    assert few == many == [(0, 1, "one <b>Two</b> three"), (0, 2, "nothing..."), (1, 1, "two...")]


def by_hand(text, terms, fragments, width, lead):
    """Places tried one after the other on plain lists."""
    pieces = [m.group() for m in regex.finditer(r"[\p{L}\p{N}_]+(?:\.[\p{L}\p{N}_]+)*|[^\p{L}\p{N}_]+", text)]
    hits = [i for i, p in enumerate(pieces) if p.lower() in terms]
    places = []
    for i in hits:
        held = [pieces[j].lower() for j in hits if i <= j < i + width]
        places.append((-len(set(held)), -len(held), i))
    taken = []
    for _, _, i in sorted(places):
        span = (max(i - lead, 0), i + width)
        if len(taken) < fragments and all(span[1] <= b or e <= span[0] for b, e in taken):
            taken.append(span)
    if not taken:
        return text[:200] + "..."
    return "...".join("".join(f"<b>{p}</b>" if p.lower() in terms else p for p in pieces[b:e]) for b, e in sorted(taken))


@pytest.mark.parametrize("fragments, width, lead", [(1, 5, 0), (3, 7, 2), (9, 24, 8)])
def test_fragments(spark, fragments, width, lead):
    rng = random.Random(7)
    words = ["data", "Data", "park", "x", "y.z", "deep", "und", "été", "-", "..", "\n"]
    texts = [" ".join(rng.choices(words, k=rng.choice([0, 1, 5, 60, 300]))) for _ in range(60)]
    texts += ["", "park", "data " * 2_000, "none of it " * 50, "data" + " x" * 30_000 + " park deep"]
    asked = {0: {"data", "park", "deep"}, 1: {"été"}, 2: set()}
    page = spark.createDataFrame([(q, i, t) for q in asked for i, t in enumerate(texts)] + [(0, 999, None)], "query_id long, rank long, composite_text string")
    terms = spark.createDataFrame([(q, t) for q, found in asked.items() for t in sorted(found)] * 2, "query_id long, term string")
    for small in (True, False):
        found = {(r[0], r[1]): r[2] for r in results.search_fragments(page, terms, fragments, width, lead, small).select("query_id", "rank", "snippet").collect()}
        assert found.pop((0, 999)) is None and len(found) == len(asked) * len(texts)
        assert all(found[q, i] == by_hand(texts[i], asked[q], fragments, width, lead) for q, i in found)


def test_search_with_fragments(spark, corpus):
    _, idx = corpus
    found, _ = search_one(idx, "python data~1", fragments=2)
    plain, _ = search_one(idx, "python data~1")
    assert rows(found, "key", "rank") == rows(plain, "key", "rank")
    assert all(r[0].count("<b>") for r in found.select("snippet").collect())


def test_few_and_many_terms_agree(spark, corpus, monkeypatch):
    _, idx = corpus
    asked = queries(spark, ["data~2 a~3", "the python~", "ab~9", "programming~0 data"])
    few = rows(match.search_fuzzy(idx, asked), "query_id", "key")
    monkeypatch.setattr(match, "PUSHED_TERMS", 0)
    assert few and few == rows(match.search_fuzzy(idx, asked), "query_id", "key")


def test_requests(spark):
    asked = spark.createDataFrame(
        [(0, "q", "0", "20"), (1, "q", "1", "101"), (2, "", "1", "20"), (3, "q", "x", "20"), (4, " ", "x", "20"), (5, "q", None, None), (6, "q", "2", "100")],
        "query_id long, text string, page string, page_size string",
    )
    status = dict(rows(rank.request_validate(asked), "query_id", "status"))
    bad = "Invalid pagination parameters: page >= 1, 1 <= page_size <= 100"
    assert status == {0: bad, 1: bad, 2: "Query parameter is required", 3: bad, 4: "Query parameter is required", 5: "ok", 6: "ok"}
    clamped = {r[0]: r[1:] for r in rows(rank.request_validate(asked, "clamp"), "query_id", "page", "page_size")}
    assert clamped == {0: (1, 20), 1: (1, 100), 2: (1, 20), 3: (1, 20), 4: (1, 20), 5: (1, 20), 6: (2, 100)}


def test_search_batch_answers_every_request(spark, corpus):
    entries, idx = corpus
    asked = queries(spark, ["data", "hot", "none at all"]).withColumns({"page": F.lit(1), "page_size": F.lit(5)})
    found, pagination = search_batch(idx, asked)
    assert Counter(r["query_id"] for r in found.collect()) == {0: 5, 1: 5}
    assert {r["query_id"]: r["total_results"] for r in pagination.collect()} == {0: len(bm25(entries, "data")), 1: len(bm25(entries, "hot")), 2: 0}


# Summaries


def stored_rows(spark):
    return to_store_rows(
        spark.createDataFrame(
            [(1, "u1", "t1", "c1", None, None), (2, "u2", "t2", "c2", "existing_summary", None), (3, "u3", "t3", None, None, "fail"), (4, "u4", "t4", "c4 bad", "  ", None)],
            "key long, url string, title string, content string, summary string, error string",
        )
    )


def test_backlog(spark):
    store = stored_rows(spark)
    assert rows(summary_backlog(store), "url") == [("u1",), ("u4",)]
    assert rows(summary_backlog(store, force=True), "url") == [("u1",), ("u2",), ("u4",)]
    assert rows(summary_backlog(store, bookmarks=store.where("key <> 4")), "url") == [("u1",)]


def test_prompt(spark):
    df = spark.createDataFrame([("u", "T {url}", "c" * 6001)], "url string, title string, content string").withColumn("name", F.lit("n"))
    template = "{title}/{url}/{content}/{other}"
    assert prompt_build(df, template).first()["prompt"] == "T {url}/u/" + "c" * 6001 + "/{other}"
    assert prompt_build(df, template, max_chars=6000).first()["prompt"] == "T {url}/u/" + "c" * 6000 + ".../{other}"


def test_summaries_of_a_store(spark):
    def model(prompts):
        if prompts.str.contains("bad").any():
            raise ValueError("bad page")
        return prompts.str.len().astype(str)

    path = scratch_path(spark, "store")
    store_source.store_replace(stored_rows(spark), path)
    applied = summary_apply(prompt_build(summary_backlog(stored_rows(spark)), "{content}"), model, "m")
    assert rows(applied, "url", "summary", "summary_model") == [("u1", "2", "m"), ("u4", "Summary generation failed: bad page", "m")]
    assert rows(stored_summaries(applied), "url") == [("u1",)]
    run = stored_rows(spark).withColumnRenamed("summary", "stored_summary").join(applied.select("url", "summary"), "url", "left")
    assert summary_run_counts(run).first().asDict() == {"success": 2, "skipped": 2, "total": 4}
    assert summarise_store(spark, path, lambda p: p.str[:0] + "made", "m") == 2
    assert rows(store_source.store_scan(spark, path), "key", "url", "summary") == [(1, "u1", "made"), (2, "u2", "existing_summary"), (3, "u3", None), (4, "u4", "made")]
