import datetime as dt

import pytest
from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import content, dedup, filters, joins, numbering, ordering, parsers, stats, upsert
from pageloom.plans.ingest import ingest, ingest_into
from pageloom.schema import STORE
from pageloom.session import scratch_path
from pageloom.sources import bookmarks as exports, store as store_source

def now():
    return F.lit("2024-07-01 10:00:00").cast("timestamp")


def raw(spark):
    return spark.createDataFrame(
        [
            (1, dt.datetime(2023, 1, 1), "https://example.com", "Example", "Folder"),
            (2, None, "https://nodate.com", None, None),
            (3, dt.datetime(2023, 1, 1, 0, 0, 0, 500000), "", "No address", "Extensions"),
        ],
        "pos long, ts timestamp, url string, title string, folder string",
    )


def test_normalize(spark):
    assert rows(exports.bookmark_normalize(raw(spark)), "pos", "name", "date_added", "type", "guid") == [
        (1, "Example", "2023-01-01T00:00:00", "url", "N/A")
    ]
    assert rows(exports.bookmark_export_normalize(raw(spark)), "pos", "name", "folder", "date_added") == [
        (1, "Example", "Folder", "1672531200.000000"),
        (2, "", "", "N/A"),
        (3, "No address", "Extensions", "1672531200.500000"),
    ]


def test_folder_filter(spark):
    df = spark.createDataFrame(
        [("https://example.com", "url", "A"), ("", "url", "A"), ("https://x.com", "url", "Extensions"), ("https://y.com", "folder", "A"), ("https://z.com", "url", None)],
        "url string, type string, folder string",
    )
    assert rows(filters.folder_filter(df), "url") == [("https://example.com",), ("https://z.com",)]


def test_eligible_url_filter(spark):
    cases = [
        ("https://a.com", "url", "A", True), ("", "url", "A", False), ("https://a.com", "folder", "A", False),
        ("https://a.com", "url", "扩展程序", False), ("http://10.0.3.4/x", "url", "A", False),
        ("https://a.com/?u=http://10.0.0.1", "url", "A", True), ("http://10.1.0.1", "url", "A", True),
    ]
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], "i int, url string, type string, name string, keep boolean")
    assert rows(filters.eligible_url_filter(df), "i") == rows(df.where("keep"), "i")


def test_union_skips_what_cannot_be_read(spark, caplog):
    good = scratch_path(spark, "export") + ".json"
    raw(spark).write.json(good)
    union = exports.bookmark_union(spark, {"chrome": good, "opera": "/no/such/file"})
    assert rows(union, "pos", "source") == [(1, "chrome"), (2, "chrome"), (3, "chrome")]
    assert "opera" in caplog.text
    assert exports.bookmark_union(spark, {"opera": "/no/such/file"}).count() == 0
    with pytest.raises(ValueError):
        exports.bookmark_source_filter(union, "netscape")


def test_dedup_keeps_the_first_of_a_hot_group(spark):
    df = spark.range(20_000).select(
        F.col("id").alias("pos"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("url"), F.lit("x").alias("name")
    )
    found = dedup.url_dedup(df)
    assert found.where("url = 'hot'").select("pos").collect()[0][0] == 0
    assert found.count() == 1 + df.where("url <> 'hot'").count()
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and plan.index("Final") < plan.index("Partial")


@pytest.mark.parametrize("positions", [range(1000), range(-70_000, 70_000, 7), [3, 5 << 33, -(7 << 40), 9 << 50, 2], [], [42]])
def test_number_rows(spark, positions):
    df = spark.createDataFrame([(p,) for p in positions], "pos long").repartition(5)
    found = sorted((r["pos"], r["n"]) for r in numbering.number_rows(df, "pos", "n").collect())
    assert found == [(p, i + 1) for i, p in enumerate(sorted(positions))]


def test_first_rows(spark):
    df = spark.range(0, 5000, 3).withColumnRenamed("id", "pos")
    assert rows(numbering.first_rows(df, 100, "pos")) == sorted([(p,) for p in range(0, 300, 3)], key=repr)
    assert numbering.first_rows(df.union(df), 101, "pos").count() == 101


def test_sort_is_stable(spark):
    df = spark.createDataFrame([(1, "a", "x"), (2, None, "z"), (3, "b", None), (4, "a", "x"), (5, "a", "y")], "pos long, folder string, title string")
    assert [r["pos"] for r in ordering.bookmark_sort(df).collect()] == [3, 5, 1, 4, 2]


def test_key_blocks_are_bounded(spark):
    store = spark.range(1, 10_001).select(F.col("id").alias("key"), F.lit("d.com").alias("domain"), F.lit("2023-01-01").cast("date").alias("date"))
    for blocks in (stats.domain_index_build(store, 512), stats.date_index_build(store, 512)):
        assert blocks.agg(F.max(F.size("keys"))).first()[0] <= 512
        assert sorted(k for r in blocks.collect() for k in r["keys"]) == list(range(1, 10_001))


def test_video_metadata(spark):
    vid = "VIDEO_ID_11"
    snippets = spark.createDataFrame([("T" * 11, i, f"line {i}") for i in range(10)] + [(vid, 1, "World"), (vid, 0, "Hello")], "video_id string, pos long, text string")
    parts = joins.transcript_format(snippets, part_snippets=4)
    assert parts.count() == 4
    cells = joins.transcript_cells(parts)
    whole = {r["video_id"]: r["transcript"] for r in cells.collect()}
    assert whole == {vid: "Hello\nWorld", "T" * 11: "\n".join(f"line {i}" for i in range(10))}
    marks = spark.createDataFrame(
        [(1, f"https://youtu.be/{vid}", None), (2, "https://youtu.be/" + "D" * 11, None), (3, "https://youtu.be/" + "N" * 11, "kept"), (4, "https://a.b", "own"), (5, "https://youtu.be/" + "T" * 11, None)],
        "pos long, url string, description string",
    )
    meta = spark.createDataFrame([(vid, "Video Description"), ("D" * 11, "Desc"), ("T" * 11, None)], "video_id string, description string")
    found = dict(rows(joins.video_metadata_join(marks, meta, cells), "pos", "description"))
    assert found == {1: "Video Description\n\nHello\nWorld", 2: "Desc", 3: "kept", 4: "own", 5: whole["T" * 11]}


def test_parser_chain(spark, caplog):
    df = spark.createDataFrame([("u", "n", None)], "url string, name string, p1 boolean")

    def raises(row):
        raise ValueError("no")

    chain = {
        "c": parsers.row_parser(raises),
        "a": parsers.row_parser(lambda row: {**row, "p1": True}),
        "b": parsers.row_parser(lambda row: None),
        "d": lambda df: df.select("no such column"),
    }
    assert rows(parsers.parser_chain(df, chain)) == [("u", "n", True)]
    assert rows(parsers.parser_chain(df, chain, enabled=["b", "zzz"])) == [("u", "n", None)]
    assert "zzz" in caplog.text


def test_rendered_article_parser(spark):
    html = '<html><body><div class="Post-RichText">Content</div></body></html>'
    df = spark.createDataFrame([("https://zhihu.com/1", html), ("https://a.b", html), ("https://zhihu.com/2", None)], "url string, html string")
    assert rows(parsers.rendered_article(df), "url", "content") == [("https://a.b", None), ("https://zhihu.com/1", "Content"), ("https://zhihu.com/2", None)]


def page(title="Title", body="Content"):
    return f"<html><head><title>{title}</title></head><body>{body}</body></html>"


def test_compose_and_fallback(spark):
    df = spark.createDataFrame([("u1", "Title", "Text"), ("u2", "No Title", ""), ("u3", "Title", ""), ("u4", "No Title", "only")], "url string, html_title string, text string")
    ok, failed = content.content_compose(df)
    assert rows(ok, "url", "content") == [("u1", "<h1>Title</h1>\n\nText"), ("u3", "<h1>Title</h1>\n\n"), ("u4", "only")]
    assert rows(failed, "url", "reason") == [("u2", "Extracted content is empty and no HTML title available")]
    rendered = spark.createDataFrame([("u2", "Selenium Content"), ("u3", " abc ")], "url string, rendered_text string")
    assert rows(content.rendered_fallback(df, rendered), "url", "text", "crawl_method") == [
        ("u1", "Text", "requests"), ("u2", "Selenium Content", "selenium"), ("u3", "", "selenium"), ("u4", "only", "requests")
    ]


def marks(spark, urls):
    return spark.createDataFrame([(i, u, f"n{i}", "url", "2023-01-01") for i, u in enumerate(urls)], "pos long, url string, name string, type string, date_added string")


def pages(spark, rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "page_id long, url string, html string, content_type string, status int")


def empty_store(spark):
    return spark.createDataFrame([], STORE)


def test_ingest_outcomes(spark):
    urls = ["https://ok.com", "https://ok.com", "https://dup.com", "https://pdf.com", "https://gone.com", "https://none.com", "https://www.zhihu.com/1", "https://zhihu.com/2", "https://blank.com", "https://void.com", "http://10.0.0.1/"]
    fetched = [
        ("https://ok.com", page(), "text/html", 200), ("https://dup.com", page(), "text/html; charset=utf-8", 200),
        ("https://pdf.com", "%PDF", "application/pdf", 200), ("https://gone.com", "x", "text/html", 404),
        ("https://blank.com", "<p> </p>", "text/html", 200), ("https://void.com", "<p> </p>", "text/html", 200),
    ]
    rendered = spark.createDataFrame(
        [("https://www.zhihu.com/1", "an answer"), ("https://zhihu.com/2", "abc"), ("https://blank.com", "made by script")], "url string, rendered_text string"
    )
    done = ingest(marks(spark, urls), pages(spark, fetched), empty_store(spark), now(), rendered)
    outcome = {r["url"]: (r["error"], r["content"]) for r in done.rows.collect()}
    assert outcome == {
        "https://ok.com": (None, "<h1>Title</h1>\n\nTitle\nContent"),
        "https://pdf.com": ("Non-text content (Content-Type: application/pdf)", None),
        "https://gone.com": ("Request failed: 404", None),
        "https://none.com": ("Request failed: no response", None),
        "https://www.zhihu.com/1": (None, "an answer"),
        "https://zhihu.com/2": ("Zhihu content crawl failed", None),
        "https://blank.com": (None, "made by script"),
        "https://void.com": ("Extracted content is empty and no HTML title available", None),
    }
    assert sorted(r["key"] for r in done.rows.collect()) == list(range(1, 9))
    assert done.counts.first().asDict() == {"valid": 10, "stored": 3, "skipped": 1, "failed": 5}
    assert done.failures.count() == 5
    left_out = ingest(marks(spark, urls), pages(spark, fetched), empty_store(spark), now(), rendered, skip_unreachable=True)
    assert left_out.rows.count() == 3 and left_out.failures.count() == 5
    limited = ingest(marks(spark, urls), pages(spark, fetched), empty_store(spark), now(), rendered, limit=2)
    assert rows(limited.rows, "url") == [("https://ok.com",), ("https://pdf.com",)]


@pytest.mark.parametrize("charset", ["gbk", "utf-8"])
def test_ingest_repairs_wrongly_decoded_pages(spark, charset):
    title, text = ("网页标题" * 4, "中文网页内容" * 5) if charset == "gbk" else ("äöüß" * 4, "éüöß" * 6)
    garbled = page(title, text).encode(charset).decode("latin-1")
    shown = spark.createDataFrame([("https://blank.com", text[::-1].encode(charset).decode("latin-1"))], "url string, rendered_text string")
    fetched = [("https://a.com", garbled, "text/html", 200), ("https://b.com", page("B"), "text/html", 200), ("https://blank.com", "<p> </p>", "text/html", 200)]
    args = marks(spark, ["https://a.com", "https://b.com", "https://blank.com"]), pages(spark, fetched), empty_store(spark), now(), shown
    found = {r["url"]: r["content"] for r in ingest(*args, charset=charset).rows.collect()}
    assert found["https://a.com"] == f"<h1>{title}</h1>\n\n{title}\n{text}"
    assert found["https://blank.com"] == text[::-1]
    assert found["https://b.com"] == f"<h1>B</h1>\n\nB\n{page.__defaults__[1]}"


def test_ingest_again_adds_nothing(spark):
    store, failures = scratch_path(spark, "store"), scratch_path(spark, "failures")
    args = marks(spark, ["https://a.com", "https://b.com", "https://c.com"]), pages(spark, [("https://a.com", page("A"), "text/html", 200), ("https://b.com", page("B"), "text/html", 200)])
    ingest_into(*args, store, failures, "run1", now())
    first = rows(store_source.store_scan(spark, store), "key", "url", "error")
    again = ingest_into(*args, store, failures, "run2", now())
    assert again.rows.count() == 0 and again.counts.first()["skipped"] == 3
    assert rows(store_source.store_scan(spark, store), "key", "url", "error") == first
    assert len(first) == 3
    more = marks(spark, ["https://a.com", "https://d.com"]), pages(spark, [("https://d.com", page("A"), "text/html", 200)])
    third = ingest_into(*more, store, failures, "run3", now())
    # A new address with content that is stored already is dropped without a failure.
    assert third.rows.count() == 0 and third.failures.count() == 0


def test_parsers_decide_the_url(spark):
    parked = "chrome-extension://e/s.html?url=https%3A%2F%2Fok.com"
    done = ingest(
        marks(spark, [parked, "https://ok.com"]), pages(spark, [("https://ok.com", page(), "text/html", 200)]), empty_store(spark), now(),
        parsers={"a_suspended_tabs": parsers.suspended_tabs},
    )
    assert rows(done.rows, "key", "url", "name", "domain") == [(1, "https://ok.com", "n0", "ok.com")]


def test_upsert(spark):
    store = upsert.to_store_rows(spark.createDataFrame([(3, "https://a.com", "old a"), (7, "https://b.com", "old b")], "key long, url string, name string"))
    batch = spark.createDataFrame(
        [(1, "https://new.com", "first"), (2, "https://a.com", "new a"), (3, " ", "blank"), (4, "https://new.com", "last"), (5, "https://c.com", "c")],
        "pos long, url string, name string",
    )
    after = upsert.store_upsert(store, batch)
    assert rows(after, "key", "url", "name") == [(3, "https://a.com", "new a"), (7, "https://b.com", "old b"), (8, "https://new.com", "last"), (9, "https://c.com", "c")]
    assert rows(upsert.store_upsert(empty_store(spark), batch), "key", "url") == [(1, "https://a.com"), (2, "https://new.com"), (3, "https://c.com")]


def test_store_versions_snapshot_and_corrupt_rows(spark, tmp_path):
    path = scratch_path(spark, "store")
    assert store_source.store_scan(spark, path).count() == 0
    assert store_source.store_snapshot(spark, path, scratch_path(spark, "b")) is None
    one = upsert.to_store_rows(spark.createDataFrame([(1, "https://a.com", "a")], "key long, url string, name string"))
    two = upsert.to_store_rows(spark.createDataFrame([(2, "https://b.com", "b")], "key long, url string, name string"))
    store_source.store_append(one, path, "s1")
    store_source.store_append(two, path, "s2")
    store_source.store_append(two, path, "s2")
    assert rows(store_source.store_scan(spark, path), "key") == [(1,), (2,)]
    other = scratch_path(spark, "compact")
    for n, df in enumerate((two, one)):
        store_source.store_append(df, other, f"s{n}")
    assert store_source.store_compact(spark, other) == 2 and store_source.store_compact(spark, other) is None
    assert rows(store_source.store_scan(spark, other), "key", "url") == [(1, "https://a.com"), (2, "https://b.com")]
    assert store_source.segment_committed(spark, other, "s0")
    copy = store_source.store_snapshot(spark, path, scratch_path(spark, "b"), "before", True, dt.datetime(2024, 1, 2, 3, 4, 5))
    assert copy.endswith("store_backup_20240102_030405_before") and spark.read.parquet(copy).count() == 2
    store_source.store_replace(store_source.store_scan(spark, path).where("key = 2"), path)
    assert rows(store_source.store_scan(spark, path), "key") == [(2,)]
    assert store_source.current_version(spark, path) == 2
    assert store_source.segment_committed(spark, path, "s1") and not store_source.segment_committed(spark, path, "s9")
    lines = tmp_path / "lines.txt"
    lines.write_text('{"key": 1, "url": "u1"}\nnot json {\n{"key": 3, "url": "u3"}\n')
    good, bad = store_source.store_scan_permissive(spark, str(lines))
    assert rows(good, "key", "url") == [(1, "u1"), (3, "u3")] and rows(bad) == [("not json {",)]


def test_error_rows_with_original_bookmarks(spark):
    three = marks(spark, ["u1", "u2", "u3"])
    failed = spark.createDataFrame([("u3", "fail")], "url string, reason string")
    errored = joins.failed_bookmark_join(three, failed)
    both = upsert.ok_error_union(three.where("pos < 2"), errored)
    assert rows(both, "url", "error") == [("u1", None), ("u2", None), ("u3", "fail")]
    assert upsert.ok_error_union(three.where("pos < 2"), errored, skip_unreachable=True).count() == 2


def test_lookups_with_and_without_index(spark):
    store = spark.range(1, 2001).select(
        F.col("id").alias("key"), F.when(F.col("id") % 3 == 0, "hot.com").otherwise("a.com").alias("domain"),
        F.when(F.col("id") % 3 == 0, "2023-01-01").otherwise("2023-01-02").cast("date").alias("date"),
    )
    wanted = [(k,) for k in range(3, 2001, 3)]
    for index in (None, stats.domain_index_build(store, 64)):
        assert joins.lookup_by_domain(store, "HOT.com", index=index).select("key").collect() == wanted
        assert joins.lookup_by_domain(store, "HOT.com", 50, index).select("key").collect() == wanted[:50]
        assert joins.lookup_by_domain(store, "none.com", index=index).count() == 0
    for index in (None, stats.date_index_build(store, 64)):
        assert joins.lookup_by_date(store, "2023-01-01", index=index).select("key").collect() == wanted


@pytest.mark.parametrize("small", [True, False])
def test_antijoins_and_keys_for_small_and_large_batches(spark, small):
    store = upsert.to_store_rows(spark.createDataFrame([(5, "u1", "c1"), (6, "u2", None)], "key long, url string, content string"))
    batch = spark.createDataFrame([(1, "u1", "c9"), (2, "u3", "c1"), (3, "u4", None), (4, "u3", "c3")], "pos long, url string, content string")
    assert rows(joins.incremental_url_antijoin(batch, store, small), "pos") == [(2,), (3,), (4,)]
    assert rows(joins.content_antijoin(batch, store, small), "pos") == [(1,), (3,), (4,)]
    keyed = upsert.key_assign(batch.where("pos < 4"), store, small=small)
    assert rows(keyed, "pos", "key") == [(1, 5), (2, 7), (3, 8)]
    plan = joins.incremental_url_antijoin(batch, store.hint("merge"), small)._jdf.queryExecution().optimizedPlan().toString()
    assert ("LeftSemi" in plan) == small
