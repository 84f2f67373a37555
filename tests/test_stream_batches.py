"""What a micro-batch costs: few jobs when all is known, and few folders however many batches there were."""

from conftest import rows
from pyspark.sql import functions as F
from test_streaming import FIRST, SCHEMA, SECOND, arrive, now

from pageloom.operators import upsert
from pageloom.session import scratch_path
from pageloom.sources import filters, manifest, seen
from pageloom.sources import store as store_source
from pageloom.streaming import ingest as streaming


def jobs_of(spark, folder, store, checkpoint):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    running = streaming.stream_page_ingest(stream, store, checkpoint, streaming.AVAILABLE_NOW, now(), skip_unreachable=True)
    running.awaitTermination()
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(str(running.runId)))


def test_known_urls_cost_few_jobs_and_leave_no_segment(spark):
    folder, store, checkpoint = (scratch_path(spark, n) for n in ("in", "store", "checkpoint"))
    arrive(spark, folder, FIRST)
    # A page that comes twice, one that fails and is not stored, and one whose content is known.
    assert jobs_of(spark, folder, store, checkpoint) <= 30
    arrive(spark, folder, SECOND)
    assert jobs_of(spark, folder, store, checkpoint) <= 30
    before, hashes = rows(store_source.store_scan(spark, store)), rows(seen.seen_scan(spark, f"{store}/seen"))
    assert [r[1] for r in before] == ["https://a.com", "https://b.com", "https://c.com"] and len(hashes) == 5
    segments = manifest.newest(spark, store)[1]["segments"]
    arrive(spark, folder, FIRST + SECOND)
    assert jobs_of(spark, folder, store, checkpoint) <= 6
    number, state = manifest.newest(spark, store)
    assert state["segments"] == segments and len(state["names"]) == 3 and number == 3
    assert rows(store_source.store_scan(spark, store)) == before and rows(seen.seen_scan(spark, f"{store}/seen")) == hashes


def test_the_memory_is_merged_and_whole(spark, monkeypatch):
    monkeypatch.setattr(seen, "FANOUT", 3)
    path = scratch_path(spark, "seen")
    for k in range(10):
        seen.seen_merge(spark, path, lambda s, k=k: s < f"s{k}")
        seen.seen_append(spark.createDataFrame([(f"h{k}",), (f"i{k}",), (f"h{k}",)], "url_hash string"), path, f"s{k}")
    # Nine in one folder, and the last, which may be written again.
    seen.seen_merge(spark, path, lambda s: s < "s9")
    folders = manifest.newest(spark, path)[1]["folders"]
    assert [len(f["names"]) for f in folders] == [9, 1] and seen.seen_names(spark, path) == {f"s{k}" for k in range(10)}
    assert rows(seen.seen_scan(spark, path)) == sorted((f"{c}{k}",) for k in range(10) for c in "hi")
    assert rows(seen.seen_scan(spark, path, without="s9")) == sorted((f"{c}{k}",) for k in range(9) for c in "hi")
    seen.seen_append(spark.createDataFrame([("other",)], "url_hash string"), path, "s9")
    assert len(rows(seen.seen_scan(spark, path))) == 19


def test_filters_of_many_segments_lie_in_few_folders(spark, monkeypatch):
    monkeypatch.setattr(filters, "FANOUT", 3)
    path = scratch_path(spark, "store")
    for k in range(9):
        found = spark.createDataFrame([(k + 1, f"https://h.org/{k}", f"text {k}")], "key long, url string, content string")
        store_source.store_append(upsert.to_store_rows(found), path, f"s{k}")
    assert len({s["filter"] for s in manifest.newest(spark, path)[1]["segments"]}) == 1
    asked = spark.createDataFrame([("https://h.org/4",), ("https://h.org/new",)], "url string").select(F.sha2("url", 256).alias("url_hash"))
    assert rows(store_source.store_near(spark, path, asked, "url_hash"), "key") == [(5,)]
    assert rows(store_source.store_near(spark, path, asked, "url_hash", without=["s4"]), "key") == []
