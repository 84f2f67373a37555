import re

import pytest

from pageloom.llm import decontamination as d

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(text):
    return WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items):
    windows = {}
    for i, t in items:
        w = words(t)
        if w:
            m = min(10, len(w))
            for k in range(len(w) - m + 1):
                windows.setdefault(tuple(w[k : k + m]), set()).add(i)
    lengths = {len(w) for w in windows}
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for m in lengths:
            for k in range(len(w) - m + 1):
                if tuple(w[k : k + m]) in windows:
                    hit |= set(range(k, k + m))
                    found |= windows[tuple(w[k : k + m])]
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [("a", "The dog lay on the rug by the door"), ("b", "cat"), ("c", None), ("d", "..."), ("e", "on the mat the dog"), ("e", "on the mat the dog"), ("f", "word word word"), ("10", "Éaßb"), ("g", " ".join(f"w{k}" for k in range(14)))]


@pytest.mark.parametrize("chunk", [1 << 20, 40])
def test_edges(spark, edge_docs, no_docs, chunk):
    bench = spark.createDataFrame(ITEMS, "item_id string, text string")
    docs = edge_docs.union(edge_docs.limit(0)).unionByName(
        spark.createDataFrame([(20, "x " + " ".join(f"W{k}" for k in range(2, 13)) + " y w0 w1")], "doc_id long, text string"), allowMissingColumns=True
    )
    got = d.contamination(docs, bench, chunk_bytes=chunk).select("doc_id", "n_words", "n_hit", "items").collect()
    expected = brute([(r["doc_id"], r["text"]) for r in docs.collect()], ITEMS)
    assert sorted((tuple(r) for r in got), key=repr) == expected
    assert d.contamination(no_docs, bench, chunk_bytes=chunk).count() == 0
    assert all(r["n_hit"] == 0 for r in d.contamination(docs, bench.limit(0)).collect())


def test_whole_table_in_several_passes(spark, documents):
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    expected = brute([(r["doc_id"], r["text"]) for r in documents.collect()], [(str(r["item_id"]), r["text"]) for r in bench.collect()])
    assert any(r[2] for r in expected)
    got = d.contamination(documents, bench, chunk_bytes=4000).select("doc_id", "n_words", "n_hit", "items").collect()
    assert sorted((tuple(r) for r in got), key=repr) == expected


def test_shifts_skip_and_find_all():
    matcher = d.WuManber([("x", "a b c d"), ("y", "c d e f g h i j k l m"), ("z", "q")])
    text = "a b c d e f g h i j k l m q a b c c d".split()
    spans, items = matcher.search([w.encode() for w in text])
    assert spans == [(0, 14)] and items == {"x", "y", "z"}
