"""The classifiers: held-out accuracy, defined results at the edges, the same model at every run."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import language_id as l
from pageloom.llm import quality_classifier as q


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.01/labels.parquet")


def test_quality_of_held_out_rows(documents, labels):
    got = q.score_quality(documents, labels)
    judged = got.join(labels, "doc_id").where("held_out")
    assert judged.agg(F.avg((F.col("predicted") == F.col("quality")).cast("int"))).first()[0] > 0.93
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, q.score_quality(documents, labels).collect()))


def test_held_out_labels_are_never_read(documents, labels):
    turned = labels.withColumn("quality", F.when(q.id_fold(F.col("doc_id"), 4) == 2, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (sorted(map(tuple, q.score_quality(documents, x).collect())) for x in (labels, turned))
    assert a == b


def test_quality_edges(spark, edge_docs, no_docs, labels):
    got = q.score_quality(edge_docs, labels).collect()
    assert len(got) == 10 and all(0 <= r["score"] <= 1 for r in got)
    assert q.score_quality(no_docs, labels).count() == 0
    assert {r["score"] for r in q.score_quality(edge_docs, labels.limit(0)).collect()} == {0.5}
    odd = spark.createDataFrame([(1, 1), (1, None), (5, 7), (None, 0)], "doc_id long, quality int")
    assert {r["predicted"] for r in q.score_quality(edge_docs, odd).collect()} == {1}


def test_dual_descent_separates_and_keeps_its_bounds():
    random = np.random.default_rng(1)
    rows = [np.unique(random.integers(0, 50, 12) + (50 if k % 2 else 0)) for k in range(80)]
    model = q.train(rows, np.arange(80) % 2)
    assert all((model.margin(r) > 0) == bool(k % 2) for k, r in enumerate(rows))


def test_languages_of_held_out_rows(documents):
    got = l.identify_languages(documents, max_per_label=100)
    judged = got.join(documents.select("doc_id", "lang"), "doc_id").where("held_out")
    assert judged.agg(F.avg((F.col("lang_pred") == F.col("lang")).cast("int"))).first()[0] > 0.97
    rows = got.collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sorted(map(tuple, rows)) == sorted(map(tuple, l.identify_languages(documents, max_per_label=100).collect()))


def test_language_edges(spark, no_docs, documents):
    rows = [(1, "the of and", "en"), (2, None, "en"), (3, "12 34 !", "en"), (4, "", None), (None, "une de la", "fr"), (5, "une de la " * 200_000, None), (6, "das ist", None), (7, "x", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit(3))
    got = {r["doc_id"]: r for r in l.identify_languages(docs).collect()}
    assert len(got) == 8 and all(got[k]["lang_pred"] == "und" and got[k]["score"] == 0 for k in (2, 3, 4))
    assert l.identify_languages(no_docs).count() == 0
    assert {r["lang_pred"] for r in l.identify_languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_grams_of_long_texts_are_those_of_the_whole(monkeypatch):
    text = "Ein längerer Text mit vielen Wörtern " * 20
    whole = l.gram_counts(text)
    monkeypatch.setattr(l, "_CHUNK", 16)
    assert (l.gram_counts(text) == whole).all() and whole.sum() == 3 * len(text) - 3


def test_document_frequencies_count_all(documents):
    frequency, n = l.document_frequencies(documents)
    texts = [r["text"] for r in documents.collect()]
    expected = sum((l.gram_counts(t) > 0).astype(int) for t in texts)
    assert n == len(texts) and (frequency == expected).all()


def test_an_id_in_many_rows_is_one_row_of_the_fit(documents, labels):
    """Rows that repeat change no model, and the number of languages bounds each one's share."""
    twice = documents.unionByName(documents.where("doc_id % 3 = 0")).unionByName(documents.where("doc_id % 3 = 0"))
    a, b = q.fit_quality(documents, labels, 200), q.fit_quality(twice, labels, 200)
    assert (a.weights == b.weights).all() and (a.bias, a.slope, a.offset) == (b.bias, b.slope, b.offset)
    few = l.fit_languages(documents, max_per_label=50, max_rows=40)
    same = l.fit_languages(documents, max_per_label=10)
    assert few.languages == same.languages and (few.weights == same.weights).all()
