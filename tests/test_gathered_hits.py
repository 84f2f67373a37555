"""Patterns over many documents: what is moved is not a row per query, word and document."""

import numpy as np
from conftest import rows
from test_search import docs

from pageloom.search import gathering, index, modes
from pageloom.session import scratch_path

ENTRIES = [(f"k{i}", "", "", "data date dates " + ("dark park" if i % 2 else "hot"), "") for i in range(8)]


def test_a_posting_moves_once_for_all_patterns_it_meets(spark, monkeypatch):
    moved, gather = [], modes.gathered
    monkeypatch.setattr(modes, "gathered", lambda hits: (moved.append(hits.count()), gather(hits))[1])
    idx = index.build_index(docs(spark, [*ENTRIES, (None, "", "", "data", "")]), scratch_path(spark, "index"), buckets=2)
    asked = spark.createDataFrame([(n, "da*") for n in range(5)] + [(5, "*ark"), (6, "d*t? *t"), (7, "zz*"), (8, "hot"), (8, "dat?s"), (8, "d?rk")], "query_id long, text string")
    got = rows(modes.search_prefix(idx, asked))
    # Of a document: data, date, dates, and dark, park or hot.
    assert moved == [4 * 4 + 4 * 5 + 1]
    every, odd, even = [f"k{i}" for i in range(8)], ["k1", "k3", "k5", "k7"], ["k0", "k2", "k4", "k6"]
    want = [(n, k) for n in range(5) for k in [*every, None]] + [(5, k) for k in odd] + [(6, k) for k in even] + [(8, k) for k in every]
    assert got == sorted(want, key=repr)
    # Without filed grams the same.
    plain = index.postings_build(docs(spark, [*ENTRIES, (None, "", "", "data", "")]), buckets=2)
    assert rows(modes.search_prefix(plain, asked)) == got


def test_a_pattern_looks_through_the_words_of_its_rarest_gram(spark):
    entries = [("k1", "", "", " ".join(f"ab{c}x" for c in "cdefgh"), ""), ("k2", "", "", "abcq zabcx", "")]
    idx = index.build_index(docs(spark, entries), scratch_path(spark, "index"), buckets=2)
    asked = spark.createDataFrame([("abc*",), ("*cq",), ("*",), ("nope*",)], "pattern string")
    grams = dict(modes._rarest_grams(idx, asked).collect())
    assert grams["*"] == "" and grams["*cq"] in ("bcq", "cq\x03", "q\x03\x03", "cq") and grams["abc*"] != "\x02\x02a"
    assert rows(modes._words_met(idx, asked).where("pattern <> '*'")) == [("*cq", "abcq"), ("abc*", "abcq"), ("abc*", "abcx")]


def test_numbers_are_packed_and_unpacked():
    numbers = np.array([0, 1, 127, 128, 300, 2**14, 2**21 - 1, 2**28, 2**33], dtype=np.int64)
    data, sizes = gathering.packed(numbers)
    assert sizes.tolist() == [1, 1, 1, 2, 2, 3, 3, 5, 5] and len(data) == sizes.sum()
    got, start = gathering.unpacked(data)
    assert got.tolist() == numbers.tolist() and start.tolist() == (np.cumsum(sizes) - sizes).tolist()
    assert gathering.unpacked(np.zeros(0, dtype=np.uint8))[0].tolist() == []
