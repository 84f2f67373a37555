import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from pageloom.llm import sharding as s


def check(docs, shards, near):
    rows = s.assign_shards(docs, shards).collect()
    key = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter(key(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect())
    slots, size = defaultdict(list), Counter()
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        size[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    total, most = sum(size.values()), max((r["size"] for r in rows), default=0)
    assert all(abs(size[k] - total / shards) <= near * total / shards + most for k in range(shards))
    return rows


def test_whole_table(documents):
    rows = check(documents, 24, 0.06)
    assert len({r["shard"] for r in rows}) == 24
    again = s.assign_shards(documents).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))


def test_copies_stay_together_unless_they_are_many(spark):
    rows = [(k, f"text number {k} {'x' * (k % 50)}") for k in range(2000)] + [(3000 + k, "a few copies") for k in range(4)] + [(4000 + k, "very many copies of this") for k in range(1500)]
    got = check(spark.createDataFrame(rows, "doc_id long, text string"), 8, 0.06)
    where = defaultdict(set)
    for r in got:
        where[r["text_crc32"]].add(r["shard"])
    assert len(where[zlib.crc32(b"a few copies")]) == 1 and len(where[zlib.crc32(b"very many copies of this")]) > 1


def test_overfull_ranges_are_cut_again(spark, monkeypatch):
    monkeypatch.setattr(s, "OVERFULL", 1.05)
    monkeypatch.setattr(s, "SAMPLE_PER_RANGE", 4)
    rows = [(k, f"text {k}") for k in range(6000)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), 24, 0.01)


@pytest.mark.parametrize("shards", [1, 3, 24])
def test_edges(edge_docs, no_docs, shards):
    check(edge_docs.withColumn("shard", F.lit("x")), shards, 0.1)
    assert s.assign_shards(no_docs, shards).count() == 0


def test_main_path_is_native(documents):
    plan = s.assign_shards(documents)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "NestedLoop" not in plan
