"""The store: scans, snapshots, upserts, summaries."""

from __future__ import annotations

import datetime as dt

import pandas as pd
from pyspark.sql import functions as F

from pageloom.functions.text import content_hash
from pageloom.operators import joins, summaries, upsert
from pageloom.operators.joins import with_url_hash
from pageloom.queries import query
from pageloom.queries.inputs import CRAWLED, STORED, once, store, store_path, stored, table
from pageloom.session import scratch_path, staged
from pageloom.sources import store as store_source

_SHOWN = "key, url, coalesce(content_hash, 'none') AS content_hash, coalesce(summary, 'none') AS summary, CAST(date AS VARCHAR) AS date"


def _shown(df):
    def text(name):
        return F.coalesce(F.col(name), F.lit("none")).alias(name)

    return df.select("key", "url", text("content_hash"), text("summary"), F.col("date").cast("string").alias("date"))


@query("store_scan", f"WITH {STORED} SELECT {_SHOWN} FROM stored")
def _(spark, sf):
    return _shown(store_source.store_scan(spark, store_path(spark, sf)))


_READABLE = "(NOT contains(domain, 'src3.') OR content IS NULL OR contains(content, chr(10)))"


@query(
    "store_scan_permissive",
    f"""WITH {STORED} SELECT 'good' AS kind, url AS record, key FROM stored WHERE {_READABLE}
    UNION ALL SELECT 'bad', content, -1 FROM stored WHERE NOT {_READABLE}""",
)
def _(spark, sf):
    """Stored rows as JSON lines; where a page of one source is a single line, that text stands there instead."""
    spoilt = F.contains("domain", F.lit("src3.")) & F.col("content").isNotNull() & ~F.contains("content", F.lit("\n"))

    def make(path):
        rows = store(spark, sf)
        line = F.when(F.coalesce(spoilt, F.lit(False)), F.col("content")).otherwise(F.to_json(F.struct(*rows.columns)))
        rows.select(line.alias("value")).write.text(path)

    good, bad = store_source.store_scan_permissive(spark, once(spark, sf, "store-lines", make))
    return good.select(F.lit("good").alias("kind"), F.col("url").alias("record"), "key").unionByName(
        bad.select(F.lit("bad").alias("kind"), "record", F.lit(-1).cast("bigint").alias("key"))
    )


@query("store_snapshot", f"WITH {STORED} SELECT {_SHOWN} FROM stored")
def _(spark, sf):
    base = scratch_path(spark, "backups")
    copy = store_source.store_snapshot(spark, store_path(spark, sf), base, "pre_crawl", True, dt.datetime(2024, 7, 1))
    return _shown(spark.read.schema(store(spark, sf).schema).parquet(copy))


@query("store_rebuild", f"WITH {STORED} SELECT {_SHOWN} FROM stored WHERE error IS NULL")
def _(spark, sf):
    path = scratch_path(spark, "rebuilt")
    store_source.store_replace(store(spark, sf), path)
    store_source.store_rebuild(store(spark, sf).where("error IS NULL"), path)
    return _shown(store_source.store_scan(spark, path))


def _batch(spark, sf):
    """Events as a batch: known URLs again with another name, new ones, blank ones, and the same one several times."""
    known = stored(spark, sf).select(F.col("key").alias("n"), "url")
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    fresh = F.concat(F.lit("https://new.example.org/"), F.col("user_id").cast("string"))
    url = F.when(F.col("event_type") == "error", " ").when(F.col("event_type") == "click", F.col("url")).otherwise(fresh)
    return events.join(known, F.col("user_id") + 1 == F.col("n"), "left").select(
        F.col("event_id").alias("pos"), url.alias("url"), F.concat(F.lit("event "), F.col("event_id").cast("string")).alias("name"),
        F.concat(F.lit("body "), F.col("event_type")).alias("content"),
    )


_BATCH = """batch0 AS (SELECT event_id AS pos, CASE event_type WHEN 'error' THEN ' ' WHEN 'click' THEN url
      ELSE 'https://new.example.org/' || user_id END AS url, 'event ' || event_id AS name, 'body ' || event_type AS content
    FROM events LEFT JOIN stored ON user_id + 1 = key),
  batch AS (SELECT * FROM batch0 WHERE trim(url) <> '' QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos DESC) = 1),
  keyed AS (SELECT coalesce(key, (SELECT max(key) FROM stored) + row_number() OVER (PARTITION BY key IS NULL ORDER BY pos)) AS key,
      b.url, b.name, b.content FROM batch b LEFT JOIN stored s ON s.url = b.url)"""


_UPSERTED = f"""WITH {STORED}, {_BATCH} SELECT key, url, name, coalesce(content, 'none') AS content, coalesce(guid, 'none') AS guid FROM (
      SELECT key, url, name, content, guid FROM stored WHERE url NOT IN (SELECT url FROM batch)
      UNION ALL SELECT key, url, name, content, NULL FROM keyed)"""


def _upserted(after):
    return after.select("key", "url", "name", F.coalesce("content", F.lit("none")).alias("content"), F.coalesce("guid", F.lit("none")).alias("guid"))


@query("store_upsert", _UPSERTED)
def _(spark, sf):
    return _upserted(upsert.store_upsert(store(spark, sf), _batch(spark, sf)))


def _with_deltas(spark, sf):
    """A copy of the store with the batch over it, in two deltas and the first of them once more."""
    path = scratch_path(spark, "deltas")
    store_source.store_replace(stored(spark, sf), path)
    batch = _batch(spark, sf)
    # URLs keep the order of first coming, so keys are those of one upsert.
    upsert.upsert_into(batch, path)
    changed = batch.withColumn("name", F.concat(F.lit("not yet "), "name"))
    upsert.upsert_into(changed, path)
    upsert.upsert_into(batch, path)
    return path


@query("store_upsert_delta", _UPSERTED)
def _(spark, sf):
    return _upserted(store_source.store_scan(spark, _with_deltas(spark, sf)))


@query("store_fold", _UPSERTED)
def _(spark, sf):
    path = _with_deltas(spark, sf)
    store_source.store_fold(spark, path, buckets=16)
    return _upserted(store_source.store_scan(spark, path))


def _in_segments(spark, sf):
    """The store in four segments, and the batch's first delta over them."""

    def make(path):
        for i in range(4):
            store_source.store_append(stored(spark, sf).where(F.col("key") % 4 == i), path, f"part-{i}")
        upsert.upsert_into(_batch(spark, sf), path)

    return once(spark, sf, "store-segments", make)


def _offers(spark, sf):
    """A page per supplier: at the address of a stored one or a new one, with the text of a document or a new one."""
    # Texts are hashed where they lie: only hashes move.
    known = table(spark, sf, "documents").select(F.col("doc_id").alias("s_suppkey"), content_hash(F.col("text")).alias("text_hash"))
    urls = stored(spark, sf).select((F.col("key") - 1).alias("s_suppkey"), "url")
    suppliers = table(spark, sf, "supplier").join(known, "s_suppkey", "left").join(urls, "s_suppkey", "left")
    url = F.when(F.col("s_nationkey") < 12, F.col("url")).otherwise(F.concat(F.lit("https://s.example.org/"), F.col("s_suppkey").cast("string")))
    offered = content_hash(F.concat(F.lit("offer "), F.col("s_suppkey").cast("string")))
    hashes = F.when(F.col("s_acctbal") > 4000, F.col("text_hash")).otherwise(offered)
    hashed = with_url_hash(suppliers.select("s_suppkey", url.alias("url"), hashes.alias("content_hash")))
    # Looked up and joined: made once.
    return staged(hashed, "offers")


_OFFERS = f"""{STORED}, {_BATCH}, now AS (SELECT url, content FROM stored WHERE url NOT IN (SELECT url FROM batch) UNION ALL SELECT url, content FROM batch),
  offers AS (SELECT s_suppkey, CASE WHEN s_nationkey < 12 THEN url ELSE 'https://s.example.org/' || s_suppkey END AS url,
      CASE WHEN s_acctbal > 4000 THEN text ELSE 'offer ' || s_suppkey END AS content
    FROM supplier LEFT JOIN documents ON doc_id = s_suppkey LEFT JOIN stored ON key = s_suppkey + 1)"""


@query("incremental_url_antijoin_segments", f"WITH {_OFFERS} SELECT s_suppkey FROM offers o WHERE NOT EXISTS (FROM now n WHERE n.url = o.url)")
def _(spark, sf):
    offers = _offers(spark, sf)
    near = store_source.store_near(spark, _in_segments(spark, sf), offers, "url_hash")
    return joins.incremental_url_antijoin(offers, near).select("s_suppkey")


@query("content_antijoin_segments", f"WITH {_OFFERS} SELECT s_suppkey FROM offers o WHERE NOT EXISTS (FROM now n WHERE n.content = o.content)")
def _(spark, sf):
    offers = _offers(spark, sf)
    near = store_source.store_near(spark, _in_segments(spark, sf), offers, "content_hash")
    return joins.content_antijoin(offers, near).select("s_suppkey")


# Summaries

_BACKLOG = "content IS NOT NULL AND error IS NULL AND trim(coalesce(summary, '')) = ''"


@query("summary_backlog", f"WITH {STORED} SELECT key, url FROM stored WHERE {_BACKLOG}")
def _(spark, sf):
    return summaries.summary_backlog(store(spark, sf)).select("key", "url")


def stand_in():
    """A stand-in for a model: says how long the prompt is, and gives up on some.

    A function made here travels to the workers whole, they need not import this package.
    """

    def describe(prompts: pd.Series) -> pd.Series:
        if prompts.str.contains("src5[. ]").any():
            raise ValueError("cannot take this one" if len(prompts) == 1 else "cannot take these together")
        return prompts.map(lambda p: f"{len(p)} characters")

    return describe


_TEMPLATE = "{title} | {url} | {content}"
_FAILS = "regexp_matches(prompt, 'src5[. ]')"
_PROMPTED = f"""backlog AS (SELECT *, coalesce(title, name) || ' | ' || url || ' | ' ||
    content AS prompt FROM stored WHERE {_BACKLOG})"""


@query(
    "summary_apply",
    f"""WITH {STORED}, {_PROMPTED} SELECT key, CASE WHEN {_FAILS} THEN 'Summary generation failed: cannot take this one'
      ELSE length(prompt) || ' characters' END AS summary, 'stub' AS summary_model FROM backlog""",
)
def _(spark, sf):
    prompted = summaries.prompt_build(summaries.summary_backlog(store(spark, sf)), _TEMPLATE)
    return summaries.summary_apply(prompted, stand_in(), "stub").select("key", "summary", "summary_model")


@query(
    "summary_run_counts",
    f"""WITH {STORED}, {_PROMPTED} SELECT
      (SELECT count(*) FROM stored WHERE content IS NOT NULL AND error IS NULL AND trim(coalesce(summary, '')) <> '')
        + (SELECT count(*) FROM backlog WHERE NOT {_FAILS}) AS success,
      (SELECT count(*) FROM stored WHERE content IS NULL OR error IS NOT NULL OR trim(coalesce(summary, '')) <> '') AS skipped,
      (SELECT count(*) FROM stored) AS total""",
)
def _(spark, sf):
    rows = store(spark, sf)
    made = summaries.summary_apply(summaries.prompt_build(summaries.summary_backlog(rows), _TEMPLATE), stand_in(), "stub")
    run = rows.withColumn("stored_summary", F.col("summary")).drop("summary").join(made.select("key", "summary"), "key", "left")
    return summaries.summary_run_counts(run)


@query(
    "summarise_store",
    f"""WITH {STORED}, {_PROMPTED} SELECT key, url, coalesce(CASE WHEN p.key IS NOT NULL AND NOT {_FAILS}
      THEN length(prompt) || ' characters' ELSE s.summary END, 'none') AS summary
    FROM stored s LEFT JOIN (SELECT key, prompt FROM backlog) p USING (key)""",
)
def _(spark, sf):
    path = scratch_path(spark, "summarised")
    store_source.store_replace(stored(spark, sf), path)
    backlog = summaries.prompt_build(summaries.summary_backlog(store_source.store_scan(spark, path)), _TEMPLATE)
    made = summaries.summary_apply(backlog, stand_in(), "stub", F.lit(CRAWLED).cast("timestamp"))
    fit = summaries.stored_summaries(made)
    # A prompt is sent once: what the store knows of the rows is looked up by those that need a summary.
    upsert.upsert_into(fit, path, "key", asked=backlog)
    return store_source.store_scan(spark, path).select("key", "url", F.coalesce("summary", F.lit("none")).alias("summary"))
