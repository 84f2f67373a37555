"""Postings, impacts and words are filed by the tasks that have them."""

from conftest import rows
from pyspark.sql import functions as F
from test_search import docs

from pageloom.search import index, segments
from pageloom.session import scratch_path


def test_postings_and_impacts_are_filed_without_moving(spark, monkeypatch):
    plans, write = {}, segments._write_filed
    monkeypatch.setattr(segments, "_write_filed", lambda made, path, table, segment: (plans.__setitem__(table, made._jdf.queryExecution().toString()), write(made, path, table, segment)))
    monkeypatch.setattr(segments, "BLOCK_BITS", 1)
    entries = [(f"k{i}", "some title", f"https://x.org/{i}", "words words " + "more " * (i % 3), "") for i in range(9)]
    idx = index.build_index(docs(spark, entries + [("k1", "again", "u", "later", "")]).withColumn("pos", F.monotonically_increasing_id()), scratch_path(spark, "index"), buckets=2)
    assert "Exchange" not in plans["postings"] and "Exchange" not in plans["impacts"]
    assert idx.docs.count() == 9 and idx.vocabulary.where("term = 'later'").count() == 0
    keys = ["field", "bucket", "term", "seg", "block", "tf"]
    want = idx.postings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.min("dl").alias("low"), F.max("dl").alias("high"))
    got = idx.impacts.groupBy(*keys).agg(F.sum("n").alias("n"), F.min("min_dl").alias("low"), F.max("max_dl").alias("high"))
    assert rows(got) == rows(want)


def test_an_addition_writes_no_text_that_is_there(spark, monkeypatch):
    path, kept = scratch_path(spark, "index"), []
    entries = [(f"k{i}", "", "", f"word{i}", "") for i in range(6)]
    segments.index_append(docs(spark, entries[:5]), path, buckets=2)
    write = segments.staged
    monkeypatch.setattr(segments, "staged", lambda df, name: (kept.append((df.columns, write(df, name))), kept[-1][1])[1])
    segments.index_append(docs(spark, [*entries, (None, "", "", "nameless", "")]), path, buckets=2)
    assert [made.count() for columns, made in kept if "content" in columns] == [2]
    assert segments.read_index(spark, path).docs.count() == 7
