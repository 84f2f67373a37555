"""A word has its lookups once in an index, however many segments hold it; merged segments are summed, not counted again."""

from conftest import rows
from pyspark.sql import functions as F
from test_search import docs, queries

from pageloom.search import index, match, modes, segments
from pageloom.session import scratch_path
from pageloom.sources import manifest

ENTRIES = [(f"k{i}", "some title", f"https://x.org/{i}", f"shared words number{i}", "short" if i % 2 else "") for i in range(10)]


def _grown(spark, size=1, times=10, path=None):
    path = path or scratch_path(spark, "index")
    for i in range(times):
        segments.index_append(docs(spark, ENTRIES[: size * (i + 1)]), path, buckets=2)
    return path, segments.read_index(spark, path)


def test_words_are_filed_once_for_all_segments(spark):
    path, idx = _grown(spark, 2, 5)
    whole = index.build_index(docs(spark, ENTRIES), scratch_path(spark, "index"), buckets=2)
    assert len(manifest.newest(spark, path)[1]["segments"]) < 5
    assert rows(idx.heads) == rows(whole.heads) and rows(idx.grams) == rows(whole.grams)
    assert rows(idx.deletions.distinct()) == rows(whole.deletions)
    assert rows(idx.vocabulary) == rows(whole.vocabulary.select(*idx.vocabulary.columns))
    assert rows(idx.corpus, "field", "n_docs", F.round("avg_len", 9)) == rows(whole.corpus, "field", "n_docs", F.round("avg_len", 9))
    # Nothing new, no lookups: the words of this one are there.
    before = manifest.newest(spark, path)[1]["lookups"]
    more = segments.index_append(docs(spark, [("k99", "title", "", "shared short words", "")]), path)
    assert manifest.newest(spark, path)[1]["lookups"] == before
    assert rows(match.search_fuzzy(more, queries(spark, ["shered~1 shrt~1"])), "key") == [(f"k{i}",) for i in (1, 3, 5, 7, 9)] + [("k99",)]
    assert modes.search_prefix(more, queries(spark, ["number*"])).count() == 10


def test_folders_of_lookups_are_merged(spark, monkeypatch):
    monkeypatch.setattr(segments, "LOOKUP_FAN_IN", 2)
    path, idx = _grown(spark, 2, 4)
    lookups = manifest.newest(spark, path)[1]["lookups"]
    assert len(lookups) < 4 and sum(s["words"] for s in lookups) >= idx.heads.count()
    whole = index.build_index(docs(spark, ENTRIES[:8]), scratch_path(spark, "index"), buckets=2)
    assert rows(idx.grams) == rows(whole.grams) and rows(idx.heads) == rows(whole.heads)


def test_an_index_without_named_lookups_is_read(spark):
    path, idx = _grown(spark, 5, 1)
    number, state = manifest.newest(spark, path)
    manifest.commit(spark, path, number + 1, {k: v for k, v in state.items() if k != "lookups"})
    assert rows(segments.read_index(spark, path).grams) == rows(idx.grams)
    whole = index.build_index(docs(spark, ENTRIES), scratch_path(spark, "index"), buckets=2)
    assert rows(segments.index_append(docs(spark, ENTRIES), path).heads) == rows(whole.heads)


def test_many_new_keys_meet_by_their_hashes_first(spark, monkeypatch):
    monkeypatch.setattr(segments, "BROADCAST_ROWS", 1)
    plans, write = [], segments.staged
    monkeypatch.setattr(segments, "staged", lambda df, name: (plans.append((name, df._jdf.queryExecution().toString())), write(df, name))[1])
    path, idx = _grown(spark, 5, 1)
    entries = [*ENTRIES, (None, "", "", "nameless", "")]
    idx = segments.index_append(docs(spark, entries), path)
    assert idx.docs.count() == 11 and idx.docs.where("key IS NULL").count() == 1
    assert "xxhash64" in [p for name, p in plans if name == "new-documents"][-1]
