from conftest import rows
from pyspark.sql import functions as F

from pageloom.plans.summarise import summary_scan, with_summaries
from pageloom.session import scratch_path
from pageloom.sources.store import store_replace, store_scan
from pageloom.streaming import ingest as streaming

SCHEMA = "pos long, url string, name string, type string, date_added string, html string, content_type string, status int"


def now():
    return F.lit("2024-07-01 10:00:00").cast("timestamp")


def arrive(spark, folder, entries):
    df = spark.createDataFrame(
        [(pos, url, f"n{pos}", "url", "2023-01-01", f"<title>{title}</title><p>{title}</p>", kind, 200) for pos, url, title, kind in entries], SCHEMA
    )
    df.coalesce(1).write.mode("append").parquet(folder)


def drain(spark, folder, store, checkpoint, **options):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder)
    streaming.stream_page_ingest(stream, store, checkpoint, streaming.AVAILABLE_NOW, now(), **options).awaitTermination()


FIRST = [(1, "https://a.com", "A", "text/html"), (2, "https://b.com", "B", "text/html"), (3, "https://a.com", "A again", "text/html"), (4, "https://p.com", "P", "application/pdf")]
SECOND = [(11, "https://a.com", "new text", "text/html"), (12, "https://c.com", "C", "text/html"), (13, "https://d.com", "B", "text/html"), (14, "https://p.com", "P", "text/html")]


def test_stream_resumes_and_replays(spark):
    folder, store, checkpoint = (scratch_path(spark, n) for n in ("in", "store", "checkpoint"))
    arrive(spark, folder, FIRST)
    drain(spark, folder, store, checkpoint)
    first = [(1, "https://a.com", "n1", None), (2, "https://b.com", "n2", None), (3, "https://p.com", "n4", "Non-text content (Content-Type: application/pdf)")]
    assert rows(store_scan(spark, store), "key", "url", "name", "error") == first
    arrive(spark, folder, SECOND)
    drain(spark, folder, store, checkpoint)
    # Known addresses are skipped, known content too: only one page is new.
    both = first + [(4, "https://c.com", "n12", None)]
    assert rows(store_scan(spark, store), "key", "url", "name", "error") == both
    assert rows(streaming.stream_failures(spark, store), "url") == [("https://p.com",)]
    # A stream that lost its checkpoint sees every file again and changes nothing.
    drain(spark, folder, store, scratch_path(spark, "checkpoint"))
    assert rows(store_scan(spark, store), "key", "url", "name", "error") == both
    store_replace(store_scan(spark, store), store)
    drain(spark, folder, store, checkpoint)
    assert rows(store_scan(spark, store), "key", "url", "name", "error") == both


def test_stream_is_the_batch(spark):
    from pageloom.plans.ingest import ingest_into

    folder, store, other, failures = (scratch_path(spark, n) for n in ("in", "store", "other", "failures"))
    arrive(spark, folder, FIRST)
    drain(spark, folder, store, scratch_path(spark, "checkpoint"))
    batch = spark.read.schema(SCHEMA).parquet(folder)
    ingest_into(batch.drop("html", "content_type", "status"), batch.withColumn("page_id", F.col("pos")), other, failures, "one", now())
    assert rows(store_scan(spark, store)) == rows(store_scan(spark, other))


def test_stream_summaries(spark):
    folder, store, side, c1, c2 = (scratch_path(spark, n) for n in ("in", "store", "side", "c1", "c2"))
    calls = spark.sparkContext.accumulator(0)

    def model(prompts):
        calls.add(len(prompts))
        return prompts.str.len().astype(str)

    def summarise():
        streaming.stream_summary_backlog(
            spark, store, model, "m", side, c2, streaming.AVAILABLE_NOW, now()
        ).awaitTermination()

    arrive(spark, folder, FIRST)
    drain(spark, folder, store, c1)
    summarise()
    merged = with_summaries(store_scan(spark, store), summary_scan(spark, side))
    assert rows(merged, "url", "summary_model") == [("https://a.com", "m"), ("https://b.com", "m"), ("https://p.com", None)]
    arrive(spark, folder, SECOND)
    drain(spark, folder, store, c1)
    summarise()
    summarise()
    merged = with_summaries(store_scan(spark, store), summary_scan(spark, side))
    assert merged.where("summary IS NOT NULL").count() == 3
    assert calls.value == 3


def test_a_second_folder_under_a_new_checkpoint_is_not_lost(spark):
    one, two, store = (scratch_path(spark, n) for n in ("one", "two", "store"))
    arrive(spark, one, FIRST[:1])
    drain(spark, one, store, scratch_path(spark, "checkpoint"))
    arrive(spark, two, FIRST[1:2])
    drain(spark, two, store, scratch_path(spark, "checkpoint"))
    assert rows(store_scan(spark, store), "url") == [("https://a.com",), ("https://b.com",)]


def test_a_failed_prompt_comes_again_and_a_rewritten_store_costs_nothing(spark):
    folder, store, side, c1, c2 = (scratch_path(spark, n) for n in ("in", "store", "side", "c1", "c2"))
    calls, broken = spark.sparkContext.accumulator(0), [True]

    def summarise():
        fails = broken[0]

        def model(prompts):
            calls.add(len(prompts))
            if fails and prompts.str.contains("b.com").any():
                raise ValueError("not now")
            return prompts.str.len().astype(str)

        streaming.stream_summary_backlog(spark, store, model, "m", side, c2, streaming.AVAILABLE_NOW, now()).awaitTermination()
        return rows(with_summaries(store_scan(spark, store), summary_scan(spark, side)).where("summary IS NOT NULL"), "url")

    arrive(spark, folder, FIRST)
    drain(spark, folder, store, c1)
    assert summarise() == [("https://a.com",)]
    broken[0] = False
    assert summarise() == [("https://a.com",)]
    store_replace(store_scan(spark, store), store)
    before = calls.value
    assert summarise() == [("https://a.com",), ("https://b.com",)] and calls.value == before + 1
    store_replace(store_scan(spark, store), store)
    assert summarise() == [("https://a.com",), ("https://b.com",)] and calls.value == before + 1


def test_what_was_tried_is_not_tried_again(spark):
    """Three batches and a restart: failures that are not stored, and copies of stored content, are looked at once."""
    from pageloom.sources.seen import seen_scan

    folder, store, checkpoint = (scratch_path(spark, n) for n in ("in", "store", "checkpoint"))
    for k, entries in enumerate((FIRST, SECOND, [(21, "https://p.com", "P", "application/pdf"), (22, "https://d.com", "now new", "text/html"), (23, "https://e.com", "E", "text/html")])):
        arrive(spark, folder, entries)
        drain(spark, folder, store, checkpoint, skip_unreachable=True)
        failed = rows(streaming.stream_failures(spark, store), "pos", "url")
        assert failed == [(4, "https://p.com")]
    # p.com became readable and d.com got other content after they were tried.
    stored = [("https://a.com",), ("https://b.com",), ("https://c.com",), ("https://e.com",)]
    assert rows(store_scan(spark, store), "url") == stored
    drain(spark, folder, store, scratch_path(spark, "checkpoint"), skip_unreachable=True)
    assert rows(store_scan(spark, store), "url") == stored and rows(streaming.stream_failures(spark, store), "pos", "url") == [(4, "https://p.com")]
    assert seen_scan(spark, f"{store}/seen").distinct().count() == 6
    forgetful = scratch_path(spark, "store")
    drain(spark, folder, forgetful, scratch_path(spark, "checkpoint"), skip_unreachable=True, remember=False)
    assert ("https://d.com",) in rows(store_scan(spark, forgetful), "url")
