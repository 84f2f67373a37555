import re

import pytest

from pageloom.llm import substring_dedup as s


def units_of(text, unit):
    """Spans without white space around them, found sign by sign."""
    cuts, k = [0], 0
    while k < len(text):
        if unit == "paragraph":
            m = re.match(r"\n[ \t]*\n", text[k : k + 50])
            k += m.end() if m else 1
            cuts += [k] if m else []
            continue
        sentence = unit == "sentence" and text[k] in ".!?" and text[k + 1 : k + 2].isspace()
        k += 1
        if sentence or text[k - 1] == "\n":
            cuts.append(k)
    for a, b in zip(cuts, [*cuts[1:], len(text)]):
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if a < b:
            yield a, b


def brute(rows, unit, min_words):
    """Removed spans by (doc_id, text)."""
    docs = sorted({(d is None, d or 0, t) for d, t in rows if t})
    units = []
    for none, d, t in docs:
        for k, (a, b) in enumerate(units_of(t, unit)):
            norm = re.sub(r"\s+", " ", t[a:b]).casefold()
            if len(norm.split(" ")) >= min_words:
                units.append((none, d, k, norm, a, b, t))
    seen, removed = set(), {}
    for none, d, _, norm, a, b, t in sorted(units, key=lambda u: u[:3]):
        if norm in seen:
            removed.setdefault((None if none else d, t), []).append((a, b))
        seen.add(norm)
    return removed


def cut(text, spans):
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + text[b:]
    return text


@pytest.mark.parametrize("unit", ["line", "sentence", "paragraph"])
def test_as_brute_force(documents, unit):
    rows = [tuple(r) for r in documents.select("doc_id", "text").collect()]
    expected = brute(rows, unit, 5)
    got = s.dedup_units(documents, unit).collect()
    assert len(got) == len(rows)
    for r in got:
        spans = expected.get((r["doc_id"], r["text"]), [])
        assert [tuple(x) for x in r["removed"]] == sorted(spans)
        assert r["kept_text"] == cut(r["text"], spans)


def test_edges(edge_docs, no_docs):
    rows = [(r["doc_id"], r["text"]) for r in edge_docs.collect()]
    expected = brute(rows, "sentence", 5)
    got = s.dedup_units(edge_docs).collect()
    assert sorted(((r["doc_id"], r["text"]) for r in got), key=repr) == sorted(rows, key=repr)
    for r in got:
        assert [tuple(x) for x in r["removed"]] == expected.get((r["doc_id"], r["text"]), [])
        assert (r["kept_text"] is None) == (r["text"] is None)
    assert s.dedup_units(no_docs).count() == 0


def test_a_long_passage_inside_lines_is_caught(spark):
    passage = " ".join(f"Sentence number {k} of a passage that two documents share." for k in range(8))
    rows = [(1, "A start of its own " + passage + " and an end."), (2, "Other words come first here " + passage + " and then others.\nA last line alone.")]
    got = {r["doc_id"]: r for r in s.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not got[1]["removed"]
    assert sum(b - a for a, b in got[2]["removed"]) > 0.8 * len(passage)
    assert got[2]["kept_text"].startswith("Other words") and got[2]["kept_text"].endswith("A last line alone.")


def brute_pieces(rows, min_words=5):
    """Removed spans of each row in turn, from a dictionary of all pieces in order of (id, place, hash of the text)."""
    held = []
    for n, (d, t, key) in enumerate(rows):
        for a, b, words in s.pieces(t or "", min_words, {}):
            held.append(((d is None, d or 0, a, key), n, " ".join(words).casefold(), (a, b)))
    first, seen = {}, set()
    for rank, _, norm, _ in sorted(held, key=lambda u: u[0]):
        first.setdefault(norm, rank)
    out = [[] for _ in rows]
    later = [(d, t) in seen or seen.add((d, t)) for d, t, _ in rows]
    for rank, n, norm, span in held:
        if later[n] or rank != first[norm]:
            out[n].append(span)
    return out


def checked(spark, docs):
    from pyspark.sql import functions as F

    rows = [tuple(r) for r in docs.select("doc_id", "text", F.xxhash64("text")).collect()]
    spans = brute_pieces(rows)
    expected = sorted(((d, t, tuple(x), None if t is None else cut(t, x)) for (d, t, _), x in zip(rows, spans)), key=repr)
    got = [(r["doc_id"], r["text"], tuple(tuple(x) for x in r["removed"]), r["kept_text"]) for r in s.dedup_units(docs, "piece").collect()]
    assert sorted(got, key=repr) == expected
    return got


def test_pieces_as_brute_force(spark, documents):
    assert sum(bool(r[2]) for r in checked(spark, documents)) > 50


def test_pieces_of_edge_rows(spark, edge_docs, no_docs):
    more = [(1, "One text. It stands twice here."), (1, "One text. It stands twice here."), (None, "No id at all, twice."), (None, "No id at all, twice."), (9, "No id at all, twice."), (1, "Another text with that id. It stands twice here."), (4, "x" * 300_000 + " end"), (5, "line\n" * 20_000)]
    rows = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    got = checked(spark, rows.withColumn("h1", rows["doc_id"]).withColumn("removed", rows["text"]).withColumn("n", rows["doc_id"]))
    twice = [r for r in got if r[0] == 1 and r[1] == more[0][1]]
    assert sorted(len(r[2]) for r in twice)[1] > 0 and min(r[3].strip() for r in twice) == ""
    assert s.dedup_units(no_docs, "piece").count() == 0


def test_small_batches_of_units(spark, documents):
    held, s.BATCH_UNITS = s.BATCH_UNITS, 50
    try:
        checked(spark, documents.where("doc_id < 150").repartition(3))
    finally:
        s.BATCH_UNITS = held
