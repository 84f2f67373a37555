import math
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pageloom.llm import mixing as m


def fill(sizes, weights=(3, 1, 2), share=1.5, cap=2.0):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    left, open_, target = share * sum(sizes.values()), set(names), {}
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= cap * sizes[s]}
        if not full:
            target |= {s: left * weight[s] / total for s in open_}
            break
        target |= {s: cap * sizes[s] for s in full}
        left -= sum(cap * sizes[s] for s in full)
        open_ -= full
    return target


def check(docs, near):
    rows = m.mix(docs).collect()
    sizes = defaultdict(int)
    for r in docs.collect():
        sizes[r["source"]] += len((r["text"] or "").split())
    target = fill(sizes)
    taken = defaultdict(int)
    for r in rows:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]])
        assert 0 <= r["copies"] <= 2 and (r["size"] or not r["copies"])
        taken[r["source"]] += r["copies"] * r["size"]
    assert len(rows) == docs.count()
    for s, t in target.items():
        assert abs(taken[s] - t) <= near * max(t, 1), (s, taken[s], t)
    return rows


def test_whole_table(documents):
    rows = check(documents.where("text NOT LIKE '%\\u00a0%'"), 0.01)
    again = m.mix(documents).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in rows) == sorted((r["doc_id"], r["copies"]) for r in again)


def test_rates_are_the_exponential_tilt(documents):
    sized = documents.select("source", m.n_words_of(F.col("text")).alias("size"))
    classes = sized.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    targets = m.source_targets(classes)
    tilts = {r["source"]: r for r in m.solve_tilts(classes, targets).collect()}
    sizes = defaultdict(list)
    for r in sized.collect():
        sizes[r["source"]].append(r["size"])
    for s, r in tilts.items():
        low, high = -745.0 * r["scale"], 745.0 * r["scale"]
        words = lambda tilt: sum(x * min(2.0, math.exp(max(-700, min(50, tilt * x / r["scale"])))) for x in sizes[s])
        assert words(r["tilt"]) == pytest.approx(r["target"], rel=2e-6)


def test_hot_classes_are_ranked_in_parts(spark, monkeypatch):
    monkeypatch.setattr(m, "RANK_ROWS", 10)
    rows = [(k, "a b c", "hot") for k in range(300)] + [(1000 + k, "a " * (k + 1), "b") for k in range(30)] + [(2000 + k, "x y", None) for k in range(20)]
    check(spark.createDataFrame(rows, "doc_id long, text string, source string"), 0.03)


def test_edges(spark, edge_docs, no_docs):
    rows = m.mix(edge_docs).collect()
    assert len(rows) == edge_docs.count() and all(r["copies"] == 0 for r in rows if r["size"] == 0)
    assert m.mix(no_docs).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, "", "a"), (3, " ", "a")], "doc_id long, text string, source string")
    assert [(r["target"], r["copies"]) for r in m.mix(blank).collect()] == [(0.0, 0)] * 3
    one = spark.createDataFrame([(1, "a b c d", "a")], "doc_id long, text string, source string")
    assert m.mix(one).first()["copies"] in (1, 2)
