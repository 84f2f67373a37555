"""Fields of the composite text are read off its postings; letters are left out of each head once."""

import pyarrow as pa
from conftest import rows
from pyspark.sql import functions as F
from test_search import docs

from pageloom.search import analysis, grouping, index, match, segments
from pageloom.session import scratch_path
from pageloom.sources import fs

ENTRIES = [
    ("k1", "red page red", "https://x.org/1", "page of red things", "red again"),
    ("k2", "", "https://x.org/2", "things things", ""),
    ("k3", "only title", "", "", "summary page"),
    ("k4", None, None, None, None),
]


def test_composed_fields_have_no_rows_of_their_own(spark):
    path = scratch_path(spark, "index")
    given = docs(spark, ENTRIES)
    idx = index.build_index(given, path, buckets=2)
    (segment,) = fs.subfolders(spark, f"{path}/postings")
    assert sorted(fs.subfolders(spark, f"{path}/postings/{segment}")) == ["field=composite_text", "field=url"]
    plain = index.postings_build(given, buckets=2)
    kept = ["field", "bucket", "term", "key", "tf", "dl", "positions"]
    assert rows(idx.postings, *kept) == rows(plain.postings, *kept) and idx.postings.where("field = 'title'").count() == 4
    assert rows(idx.vocabulary) == rows(plain.vocabulary.select(*idx.vocabulary.columns))
    assert rows(idx.corpus, "field", "n_docs", F.round("avg_len", 9)) == rows(plain.corpus, "field", "n_docs", F.round("avg_len", 9))


def test_an_index_of_some_fields_has_their_rows(spark):
    idx = index.build_index(docs(spark, ENTRIES), scratch_path(spark, "index"), buckets=2, fields=("title", "composite_text"))
    assert {r[0] for r in idx.postings.select("field").distinct().collect()} == {"title", "composite_text"}
    assert idx.vocabulary.where("field = 'title' AND term = 'red'").first()["df"] == 1


def test_words_of_one_head_share_their_deletions(spark):
    words = ["interest", "interesting", "interested", "interes", "internal"]
    idx = index.build_index(docs(spark, [(f"k{i}", "", "", w, "") for i, w in enumerate(words)]), scratch_path(spark, "index"), buckets=2)
    heads = {w[: segments.HEAD_LETTERS] for w in words}
    assert {r[0] for r in idx.deletions.select("head").collect()} == heads
    cuts = idx.deletions.select("cut", "head").distinct().count()
    assert idx.deletions.count() == cuts and idx.heads.count() == len(words)
    asked = match.with_field(analysis.query_terms(spark.createDataFrame([(0, "interestin~1 intrest~1")], "query_id long, text string")))
    assert rows(match.fuzzy_lookup(idx, asked), "ord", "term") == [(0, "interesting"), (1, "interest")]


def test_a_slice_comes_in_the_order_in_which_it_is_filed():
    batch = pa.record_batch({"key": ["a", "b"], "block": [0, 0], "title": [["zz"], ["aa"]], "content": [["mm", "aa", "zz"], ["mm"]], "summary": [[], ["zz"]]})
    (got,) = grouping._slice_postings(batch, ("title", "content", "summary", "composite_text"), ("title", "content", "summary"), 4, True)
    made = got.to_pylist()
    assert [(r["bucket"], r["term"], r["key"]) for r in made] == sorted((r["bucket"], r["term"], r["key"]) for r in made) and len(made) == 6
    assert {(r["term"], r["tf"], r["tf_0"], r["tf_1"], r["dl"], r["dl_0"], r["dl_1"]) for r in made if r["key"] == "a"} == {("zz", 2, 1, 1, 4, 1, 3), ("mm", 1, 0, 1, 4, 1, 3), ("aa", 1, 0, 1, 4, 1, 3)}
