"""What an upsert brings is written once, a prompt is sent once, and no text moves where its hash is enough."""

import datetime as dt

import pandas as pd
from conftest import rows
from pyspark.sql import functions as F

from pageloom.operators import summaries, upsert
from pageloom.queries import inputs, storing
from pageloom.session import scratch_path
from pageloom.sources import store as store_source


def test_an_upsert_writes_its_rows_once(spark, monkeypatch):
    path, kept = scratch_path(spark, "store"), []
    known = spark.createDataFrame([(1, "https://a.org"), (2, "https://b.org")], "key long, url string")
    store_source.store_replace(upsert.to_store_rows(known), path)
    monkeypatch.setattr(upsert, "staged", lambda df, name, staged=upsert.staged: (kept.append(name), staged(df, name))[1])
    given = [(1, "https://b.org", "early"), (2, "https://c.org", "new"), (3, "https://b.org", "late"), (4, " ", "blank")]
    upsert.upsert_into(spark.createDataFrame(given, "pos long, url string, name string"), path)
    assert kept == ["matched"]
    assert rows(store_source.store_scan(spark, path), "key", "url", "name") == sorted([(1, "https://a.org", None), (2, "https://b.org", "late"), (3, "https://c.org", "new")], key=repr)


def test_a_prompt_is_sent_once(spark):
    path = scratch_path(spark, "store")
    given = [(i, f"https://a.org/{i}", "a title", f"text {i}") for i in range(1, 6)]
    store_source.store_replace(upsert.to_store_rows(spark.createDataFrame(given, "key long, url string, title string, content string")), path)
    sent = spark.sparkContext.accumulator(0)

    def model(prompts: pd.Series) -> pd.Series:
        sent.add(len(prompts))
        return prompts.str.len().astype(str)

    backlog = summaries.prompt_build(summaries.summary_backlog(store_source.store_scan(spark, path)))
    made = summaries.stored_summaries(summaries.summary_apply(backlog, model, "m", F.lit(dt.datetime(2024, 1, 1))))
    upsert.upsert_into(made, path, "key", asked=backlog)
    assert store_source.store_scan(spark, path).where("summary IS NOT NULL").count() == 5
    assert sent.value == 5


def _tables(spark, path):
    def put(name, given, schema):
        spark.createDataFrame(given, schema).write.parquet(f"{path}/{name}.parquet")

    ts = dt.datetime(2024, 3, 1)
    put("documents", [(i, f"text {i}", "en", "web", 6) for i in range(6)], "doc_id long, text string, lang string, source string, n_chars int")
    put("labels", [(0, 1, 0)], "doc_id long, quality int, toxic int")
    put("events", [(0, 1, "click", 5.0, ts), (1, 2, "view", 5.0, ts)], "event_id long, user_id long, event_type string, value double, ts timestamp")
    put("supplier", [(0, 1, 5000.0), (1, 20, 10.0), (2, 2, 10.0), (9, 1, 5000.0)], "s_suppkey long, s_nationkey int, s_acctbal double")


def test_offers_carry_hashes_and_the_store_is_written_once(spark):
    path = scratch_path(spark, "tables")
    _tables(spark, path)
    offers = storing._offers(spark, path)
    assert "content" not in offers.columns
    want = spark.createDataFrame([(0, "text 0"), (1, "offer 1"), (2, "offer 2"), (9, None)], "s_suppkey long, content string")
    assert rows(offers, "s_suppkey", "content_hash") == rows(want.select("s_suppkey", F.sha2("content", 256)))
    near = store_source.store_near(spark, storing._in_segments(spark, path), offers, "url_hash")
    assert {r["url"] for r in near.where("name LIKE 'event%'").collect()} == {"https://www.web.example.com/en/1", "https://new.example.org/2"}
    assert [name for _, sf, name in inputs._folders if sf == path] == ["store-segments"]
