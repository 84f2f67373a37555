"""Inputs that once were lost, took very long or ended a job."""

import json
import time

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.functions import encoding, html, text
from pageloom.operators import ordering, parsers
from pageloom.search import modes
from pageloom.search.index import postings_build, search_doc_prepare
from pageloom.session import scratch_path
from pageloom.sources import bookmarks, failures
from pageloom.operators.upsert import to_store_rows


@pytest.mark.parametrize("fn", [text.strip, text.clean_text, html.article_extract, html.html_text_extract])
def test_long_runs_of_blanks(spark, column, fn):
    run = " " * 1_000_000
    values = [f"a{run}b", f"{run}a{run}", f"a{run}\n{run}b\n\n{run}", "<p>" + run + "x</p>" + "<br>" * 20_000 + "y"]
    column(fn, ["warm"])
    start = time.time()
    got = column(fn, values)
    assert time.time() - start < 30
    if fn is text.strip:
        assert got[0] == values[0] and got[1] == "a"
    if fn is text.clean_text:
        assert got[1] == "a" and got[2] == "a\nb"
    if fn is html.article_extract:
        assert got[3] == "xy"


def test_clean_text_is_line_by_line(column):
    values = ["  Hello  \n\n  World  ", "\n \t\n", "a \u00a0\n\u2003 b", "a\r\n b", "", "x  y \n\n\n z "]
    expected = ["\n".join(x.strip() for x in v.split("\n") if x.strip()) for v in values]
    assert column(text.clean_text, values) == expected


def test_text_that_goes_bad_late_is_suspect(column):
    assert column(encoding.encoding_suspect, ["a" * 2000 + "\u00e9" * 1000, "a" * 2000]) == [True, False]


def test_words_at_the_end_of_long_contents_are_found(spark):
    store = to_store_rows(spark.createDataFrame([(1, "u1", "w " * 20_000 + "needle")], "key long, url string, content string"))
    index = postings_build(search_doc_prepare(store))
    assert index.postings.where("term = 'needle' AND field = 'content'").count() == 1


def test_exports_as_json_arrays_and_unique_positions(spark):
    base = scratch_path(spark, "exports").removeprefix("file:")
    import os

    os.makedirs(base)
    written = [{"date_added": "2023-01-01T12:00:00", "name": "A", "type": "url", "url": "https://a.com", "folder": "F"}, {"name": "B", "url": "https://b.com"}]
    for name in ("x", "y"):
        with open(f"{base}/{name}.json", "w") as out:
            json.dump(written, out, indent=2)
    union = bookmarks.bookmark_union(spark, {"chrome": f"{base}/x.json", "edge": f"{base}/y.json"})
    got = [tuple(r) for r in union.orderBy("pos").select("url", "title", "source").collect()]
    assert got == [("https://a.com", "A", "chrome"), ("https://b.com", "B", "chrome"), ("https://a.com", "A", "edge"), ("https://b.com", "B", "edge")]
    assert union.select("pos").distinct().count() == 4 and union.where("ts IS NOT NULL").count() == 2
    assert ordering.crawl_limit(union, 3).count() == 3


def test_failures_keep_their_keys(spark):
    path = scratch_path(spark, "failed")
    run = spark.createDataFrame([(5, "u5", "t", "r", "x"), (2, "u2", "t", "r", "x")], "pos long, url string, title string, reason string, timestamp string")
    failures.failed_append(run, path)
    first = rows(failures.failed_scan(spark, path, keyed=True), "key", "url")
    failures.failed_append(run.where("pos = 2"), path)
    assert first == [(1, "u2"), (2, "u5")]
    assert rows(failures.failed_scan(spark, path, keyed=True), "key", "url") == [(1, "u2"), (2, "u5"), (3, "u2")]


def test_parsers_add_fields_and_survive_wrong_types(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "pos long, name string")
    odd = parsers.row_parser(lambda r: {**r, "pos": "no number", "name": "x"} if r["pos"] == 1 else {**r, "name": "y"})
    assert rows(odd(df)) == [(1, "a"), (2, "y")]
    adds = parsers.row_parser(lambda r: {**r, "description": "d" + r["name"]}, "description string")
    assert rows(adds(df), "pos", "description") == [(1, "da"), (2, "db")]


def test_stop_words_beside_wildcards(spark):
    store = to_store_rows(spark.createDataFrame([(1, "u1", "a program of the day"), (2, "u2", "other")], "key long, url string, content string"))
    index = postings_build(search_doc_prepare(store))
    queries = spark.createDataFrame([("a", "prog*"), ("b", "the prog*"), ("c", "day prog*"), ("d", "night prog*")], "query_id string, text string")
    assert sorted({r["query_id"] for r in modes.search_prefix(index, queries).collect()}) == ["a", "b", "c"]
