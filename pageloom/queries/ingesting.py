"""Sources, de-duplication, joins, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from pageloom.functions.text import content_hash
from pageloom.operators import dedup, filters, joins, numbering, ordering, parsers, stats, upsert
from pageloom.queries import query
from pageloom.queries.inputs import (
    BOOKMARKS, BROWSER, CRAWLED, RAW_BOOKMARKS, RESPONSES, SQL_DOMAIN, SQL_EPOCH, SQL_HTML_TEXT, SQL_TITLE, STORED,
    bookmarks, once, raw_bookmarks, responses, sql_clean, store, table,
)
from pageloom.sources import bookmarks as exports, failures, pages as page_source

_TS = "coalesce(strftime(ts, '%Y-%m-%d %H:%M:%S.%f'), 'none') AS ts"


def _ts():
    return F.coalesce(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit("none")).alias("ts")


def _text(name):
    return F.coalesce(F.col(name), F.lit("none")).alias(name)


_MICROS = dict.fromkeys(("timestampFormat", "timestampNTZFormat"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def _exported(spark, sf):
    """One JSON export per browser."""

    def make(path):
        raw_bookmarks(spark, sf).write.partitionBy("source").options(**_MICROS).json(path)

    path = once(spark, sf, "exports", make)
    return {name: f"{path}/source={name}" for name in BROWSER.values()}


@query(
    "bookmark_union",
    f"""WITH {RAW_BOOKMARKS}, place AS (SELECT * FROM (VALUES {", ".join(f"('{name}', {n})" for n, name in enumerate(BROWSER.values()))}) AS v(source, nth))
    SELECT pos + nth * (1::BIGINT << 40) AS pos, {_TS}, url, coalesce(title, 'none') AS title, coalesce(folder, 'none') AS folder, source
    FROM raw_bookmarks JOIN place USING (source)""",
)
def _(spark, sf):
    schema = "pos BIGINT, ts TIMESTAMP, url STRING, title STRING, folder STRING"
    paths = {}
    for name, path in _exported(spark, sf).items():
        # Parquet exports of some browsers, JSON of the others, and one that is not there.
        rows = spark.read.schema(schema).json(path)
        as_json = name in ("chrome", "brave")

        def make(target, rows=rows, as_json=as_json):
            if as_json:
                rows.write.options(**_MICROS).json(target + ".json")
            else:
                rows.write.parquet(target)

        paths[name] = once(spark, sf, f"export-{name}", make) + (".json" if as_json else "")
    paths["opera"] = f"{sf}/no-such-export"
    union = exports.bookmark_union(spark, paths)
    return union.select("pos", _ts(), "url", _text("title"), _text("folder"), "source")


@query("bookmark_source_filter", f"WITH {RAW_BOOKMARKS} SELECT pos, url, source FROM raw_bookmarks WHERE source = 'firefox'")
def _(spark, sf):
    return exports.bookmark_source_filter(raw_bookmarks(spark, sf), "firefox").select("pos", "url", "source")


@query(
    "bookmark_normalize",
    f"WITH {BOOKMARKS} SELECT pos, url, name, type, date_added, 'N/A' AS date_last_used, 'N/A' AS guid, 'N/A' AS id FROM bookmarks",
)
def _(spark, sf):
    return bookmarks(spark, sf).select("pos", "url", "name", "type", "date_added", "date_last_used", "guid", "id")


_EXPORTED = f"""exported AS (SELECT pos, url, coalesce(title, '') AS name, 'url' AS type,
  coalesce({SQL_EPOCH}, 'N/A') AS date_added, coalesce(folder, '') AS folder FROM raw_bookmarks)"""


@query("bookmark_export_normalize", f"WITH {RAW_BOOKMARKS}, {_EXPORTED} SELECT * FROM exported")
def _(spark, sf):
    rows = exports.bookmark_export_normalize(raw_bookmarks(spark, sf))
    return rows.select("pos", "url", "name", "type", "date_added", "folder")


@query("bookmarks_json_sink", f"WITH {RAW_BOOKMARKS}, {_EXPORTED} SELECT * FROM exported WHERE url <> '' AND folder <> 'Extensions'")
def _(spark, sf):
    rows = filters.folder_filter(exports.bookmark_export_normalize(raw_bookmarks(spark, sf)))
    path = once(spark, sf, "bookmarks-json", lambda p: exports.bookmarks_json_sink(rows, p))
    return spark.read.schema("pos BIGINT, url STRING, name STRING, type STRING, date_added STRING, folder STRING").json(path)


@query("page_scan", "SELECT page_id, url, html FROM pages")
def _(spark, sf):
    return page_source.page_scan(spark, f"{sf}/pages.parquet").select("page_id", "url", "html")


_FAILED = f"""failed AS (SELECT page_id AS pos, url, {SQL_TITLE} AS title,
    'Non-text content (Content-Type: ' || content_type || ')' AS reason, '{CRAWLED}' AS timestamp
  FROM responses WHERE NOT contains(lower(content_type), 'text/html') AND NOT contains(lower(content_type), 'text/plain'))"""


def failed_pages(spark, sf):
    from pageloom.functions.html import html_title_extract

    _ok, failed = filters.content_type_filter(responses(spark, sf))
    return failed.select(
        F.col("page_id").alias("pos"), "url", html_title_extract(F.col("html")).alias("title"), "reason",
        F.lit(CRAWLED).alias("timestamp"),
    )


@query("failed_urls_sink", f"WITH {RESPONSES}, {_FAILED} SELECT url, title, reason, timestamp FROM failed")
def _(spark, sf):
    path = once(spark, sf, "failed-json", lambda p: failures.failed_urls_sink(failed_pages(spark, sf), p))
    return spark.read.schema("url STRING, title STRING, reason STRING, timestamp STRING").json(path)


@query(
    "failed_append",
    f"""WITH {RESPONSES}, {_FAILED}, both_runs AS (SELECT 1 AS run, pos, url, reason FROM failed UNION ALL SELECT 2, pos, url, reason FROM failed)
    SELECT row_number() OVER (ORDER BY run, pos) AS key, pos, url, reason FROM both_runs""",
)
def _(spark, sf):
    def make(path):
        for _run in range(2):
            failures.failed_append(failed_pages(spark, sf), path)

    path = once(spark, sf, "failed", make)
    return failures.failed_scan(spark, path, keyed=True).select("key", "pos", "url", "reason")


# De-duplication


_FIRST_URL = """first_url AS (SELECT *, sha256(url) AS url_hash FROM bookmarks
  QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1)"""


@query("url_dedup", f"WITH {BOOKMARKS}, {_FIRST_URL} SELECT pos, url, url_hash, name FROM first_url")
def _(spark, sf):
    return dedup.url_dedup(bookmarks(spark, sf)).select("pos", "url", "url_hash", "name")


@query(
    "content_dedup",
    "SELECT doc_id, sha256(text) AS content_hash, text AS content FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) = 1",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return dedup.content_dedup(docs, "doc_id").select("doc_id", "content_hash", "content")


@query("index_key_dedup", f"WITH {BOOKMARKS} SELECT url AS key, pos, name FROM bookmarks QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1")
def _(spark, sf):
    kept, _counts = dedup.index_key_dedup(bookmarks(spark, sf).withColumnRenamed("url", "key"))
    return kept.select("key", "pos", "name")


@query(
    "index_key_dedup_counts",
    f"WITH {BOOKMARKS} SELECT count(*) AS processed, count(*) - count(DISTINCT url) AS skipped, count(DISTINCT url) AS total FROM bookmarks",
)
def _(spark, sf):
    _kept, counts = dedup.index_key_dedup(bookmarks(spark, sf).withColumnRenamed("url", "key"))
    return counts


# Joins

# Pages whose number has a label count as stored already.
STORED_PAGES = "stored_pages AS (SELECT page_id + 1 AS key, url, html FROM pages JOIN labels ON doc_id = page_id)"


def stored_pages(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id")
    return (
        table(spark, sf, "pages").join(labels, F.col("doc_id") == F.col("page_id"))
        .select((F.col("page_id") + 1).alias("key"), "url", "html")
    )


@query(
    "incremental_url_antijoin",
    f"WITH {BOOKMARKS}, {STORED_PAGES} SELECT pos, url FROM bookmarks WHERE url NOT IN (SELECT url FROM stored_pages)",
)
def _(spark, sf):
    return joins.incremental_url_antijoin(bookmarks(spark, sf), stored_pages(spark, sf)).select("pos", "url")


@query(
    "content_antijoin",
    f"WITH {STORED} SELECT doc_id, text AS content FROM documents WHERE text NOT IN (SELECT content FROM stored WHERE content IS NOT NULL AND summary IS NOT NULL)",
)
def _(spark, sf):
    new = table(spark, sf, "documents").select("doc_id", F.col("text").alias("content"))
    return joins.content_antijoin(new, store(spark, sf).where("summary IS NOT NULL")).select("doc_id", "content")


@query(
    "index_update_antijoin",
    "SELECT doc_id AS key, text FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)",
)
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("key"), "text")
    return joins.index_update_antijoin(docs, table(spark, sf, "labels").select(F.col("doc_id").alias("key")))


@query(
    "existing_summary_join",
    f"""WITH {STORED}, fresh AS (SELECT doc_id, 'https://www.' || source || '.example.com/' || lang || '/' || doc_id AS url FROM documents)
    SELECT doc_id, f.url, coalesce(summary, 'none') AS stored_summary FROM fresh f LEFT JOIN stored s ON s.url = f.url""",
)
def _(spark, sf):
    place = F.concat(F.lit("https://www."), "source", F.lit(".example.com/"), "lang", F.lit("/"), F.col("doc_id").cast("string"))
    fresh = table(spark, sf, "documents").select("doc_id", place.alias("url"))
    return joins.existing_summary_join(fresh, store(spark, sf)).select("doc_id", "url", _text("stored_summary"))


@query(
    "failed_bookmark_join",
    f"""WITH {BOOKMARKS}, {RESPONSES}, {_FAILED} SELECT b.pos, b.url, b.name, f.reason AS error FROM bookmarks b JOIN failed f ON f.url = b.url""",
)
def _(spark, sf):
    return joins.failed_bookmark_join(bookmarks(spark, sf), failed_pages(spark, sf)).select("pos", "url", "name", "error")


_TRANSCRIPTS = """spoken AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) AS transcript FROM conversations GROUP BY conv_id)"""


@query("transcript_format", f"WITH {_TRANSCRIPTS} SELECT CAST(conv_id AS VARCHAR) AS video_id, 0 AS part, transcript FROM spoken")
def _(spark, sf):
    return joins.transcript_format(_snippets(spark, sf)).withColumn("part", F.col("part").cast("int"))


def _snippets(spark, sf):
    return table(spark, sf, "conversations").select(F.col("conv_id").cast("string").alias("video_id"), F.col("turn").alias("pos"), "text")


@query(
    "video_metadata_join",
    f"""WITH {_TRANSCRIPTS}, {BOOKMARKS}, videos AS (SELECT pos, CASE WHEN source = 'edge' THEN url
        ELSE 'https://youtu.be/' || lpad(CAST(pos AS VARCHAR), 11, '0') END AS url FROM bookmarks),
      meta AS (SELECT doc_id, CASE WHEN quality = 1 THEN 'About ' || doc_id ELSE '' END AS description FROM labels)
    SELECT pos, url, CASE WHEN NOT starts_with(url, 'https://youtu.be/') OR description IS NULL THEN 'none' WHEN transcript IS NULL THEN description
      WHEN description = '' THEN transcript ELSE description || chr(10) || chr(10) || transcript END AS description
    FROM videos LEFT JOIN meta ON doc_id = pos LEFT JOIN spoken ON conv_id = pos""",
)
def _(spark, sf):
    def as_id(c):
        return F.lpad(c.cast("string"), 11, "0")

    address = F.concat(F.lit("https://youtu.be/"), as_id(F.col("pos")))
    videos = bookmarks(spark, sf).select("pos", F.when(F.col("source") == "edge", F.col("url")).otherwise(address).alias("url"))
    meta = table(spark, sf, "labels").select(
        as_id(F.col("doc_id")).alias("video_id"),
        F.when(F.col("quality") == 1, F.concat(F.lit("About "), F.col("doc_id").cast("string"))).otherwise("").alias("description"),
    )
    parts = joins.transcript_format(_snippets(spark, sf))
    spoken = joins.transcript_cells(parts).withColumn("video_id", as_id(F.col("video_id")))
    return joins.video_metadata_join(videos, meta, spoken).select("pos", "url", _text("description"))


@query("lookup_by_domain", f"WITH {STORED} SELECT key, url FROM stored WHERE domain = 'src1.example.com'")
def _(spark, sf):
    return joins.lookup_by_domain(store(spark, sf), "SRC1.example.com").select("key", "url")


@query("lookup_by_date", f"WITH {STORED} SELECT key, url FROM stored WHERE date = DATE '2024-01-02'")
def _(spark, sf):
    return joins.lookup_by_date(store(spark, sf), "2024-01-02").select("key", "url")


@query("lookup_by_domain_index", f"WITH {STORED} SELECT key, url FROM stored WHERE domain = 'src1.example.com'")
def _(spark, sf):
    rows = store(spark, sf)
    return joins.lookup_by_domain(rows, "src1.example.com", index=stats.domain_index_build(rows)).select("key", "url")


@query("lookup_by_date_index", f"WITH {STORED} SELECT key, url FROM stored WHERE date = DATE '2024-01-02'")
def _(spark, sf):
    rows = store(spark, sf)
    return joins.lookup_by_date(rows, "2024-01-02", index=stats.date_index_build(rows)).select("key", "url")


# Reports


@query(
    "domain_index_build",
    f"WITH {STORED} SELECT domain, key // 4096 AS block, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS keys FROM stored WHERE domain <> '' GROUP BY ALL",
)
def _(spark, sf):
    return _listed(stats.domain_index_build(store(spark, sf)))


def _listed(blocks):
    return blocks.withColumn("keys", F.array_join(F.col("keys").cast("array<string>"), ","))


@query(
    "date_index_build",
    f"WITH {STORED} SELECT CAST(date AS VARCHAR) AS date, key // 4096 AS block, string_agg(CAST(key AS VARCHAR), ',' ORDER BY key) AS keys FROM stored GROUP BY ALL",
)
def _(spark, sf):
    return _listed(stats.date_index_build(store(spark, sf))).withColumn("date", F.col("date").cast("string"))


@query("domain_stats", f"SELECT domain, count(*) AS n FROM (SELECT {SQL_DOMAIN} AS domain FROM pages) WHERE domain <> '' GROUP BY domain")
def _(spark, sf):
    from pageloom.functions.urls import domain_extract

    return stats.domain_stats(table(spark, sf, "pages").select(domain_extract(F.col("url")).alias("domain")))


@query("date_stats", "SELECT CAST(CAST(ts AS DATE) AS VARCHAR) AS date, count(*) AS n FROM events GROUP BY ALL")
def _(spark, sf):
    return stats.date_stats(table(spark, sf, "events").select(F.to_date("ts").alias("date"))).withColumn(
        "date", F.col("date").cast("string")
    )


@query(
    "content_length_stats",
    f"""WITH {STORED} SELECT round(avg(coalesce(content_length, 0)), 6) AS avg_length, max(coalesce(content_length, 0)) AS max_length,
      min(coalesce(content_length, 0)) AS min_length FROM stored""",
)
def _(spark, sf):
    return stats.content_length_stats(store(spark, sf)).withColumn("avg_length", F.round("avg_length", 6))


@query(
    "crawl_method_counts",
    f"WITH {STORED} SELECT count(*) FILTER (crawl_method = 'selenium') AS selenium, count(*) FILTER (crawl_method = 'requests') AS requests FROM stored",
)
def _(spark, sf):
    return stats.crawl_method_counts(store(spark, sf))


@query(
    "failure_report",
    f"""WITH {RESPONSES}, {_FAILED}, numbered AS (SELECT row_number() OVER (ORDER BY pos) AS n, * FROM failed)
    SELECT n, n || '. ' || title || ' - ' || url || ' - Reason: ' || reason AS line FROM numbered""",
)
def _(spark, sf):
    return stats.failure_report(failed_pages(spark, sf))


@query("failure_counts", f"WITH {RESPONSES}, {_FAILED} SELECT reason, count(*) AS n FROM failed GROUP BY reason")
def _(spark, sf):
    return stats.failure_counts(failed_pages(spark, sf))


@query(
    "run_summary",
    f"""WITH {BOOKMARKS}, {RESPONSES}, {_FAILED}, {STORED}
    SELECT (SELECT count(*) FROM bookmarks) AS valid, (SELECT count(*) FROM stored) AS stored,
      (SELECT count(*) - count(DISTINCT url) FROM bookmarks) AS skipped,
      (SELECT count(*) FROM failed) AS failed""",
)
def _(spark, sf):
    valid = bookmarks(spark, sf)
    copies = valid.groupBy("url").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    skipped = copies.select(F.explode(F.sequence(F.lit(2), F.col("n"))).alias("copy"))
    return stats.run_summary(valid, store(spark, sf), skipped, failed_pages(spark, sf))


# Keys, order, limits


@query(
    "key_assign",
    f"""WITH {BOOKMARKS}, {_FIRST_URL}, {STORED_PAGES}, matched AS (SELECT f.pos, f.url, s.key AS known FROM first_url f LEFT JOIN stored_pages s USING (url))
    SELECT pos, url, coalesce(known, (SELECT max(key) FROM stored_pages) + row_number() OVER (PARTITION BY known IS NULL ORDER BY pos)) AS key FROM matched""",
)
def _(spark, sf):
    batch = dedup.url_dedup(bookmarks(spark, sf))
    return upsert.key_assign(batch, stored_pages(spark, sf)).select("pos", "url", "key")


@query("number_rows", "SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type <> 'click'")
def _(spark, sf):
    return numbering.number_rows(table(spark, sf, "events").where("event_type <> 'click'").select("event_id"), "event_id", "n")


@query(
    "bookmark_sort",
    f"WITH {RAW_BOOKMARKS} SELECT pos, coalesce(folder, '') AS folder, coalesce(title, '') AS title FROM raw_bookmarks ORDER BY 2 DESC, 3 DESC, 1",
)
def _(spark, sf):
    sorted_rows = ordering.bookmark_sort(raw_bookmarks(spark, sf))
    blank = F.lit("")
    return sorted_rows.select("pos", F.coalesce("folder", blank).alias("folder"), F.coalesce("title", blank).alias("title"))


@query("crawl_limit", f"WITH {BOOKMARKS}, {_FIRST_URL} SELECT pos, url FROM first_url ORDER BY pos LIMIT 25")
def _(spark, sf):
    return ordering.crawl_limit(dedup.url_dedup(bookmarks(spark, sf)), 25).select("pos", "url")


@query("summary_limit", f"WITH {STORED} SELECT key, url FROM stored ORDER BY key LIMIT 40")
def _(spark, sf):
    return ordering.summary_limit(store(spark, sf), 40).select("key", "url")


@query(
    "ok_error_union",
    f"""WITH {RESPONSES} SELECT page_id, url, CASE WHEN contains(lower(content_type), 'text/') THEN sha256(html) ELSE 'none' END AS content_hash,
      CASE WHEN contains(lower(content_type), 'text/') THEN 'none' ELSE 'Non-text content (Content-Type: ' || content_type || ')' END AS error FROM responses""",
)
def _(spark, sf):
    ok, failed = filters.content_type_filter(responses(spark, sf))
    ok = ok.select("page_id", "url", content_hash(F.col("html")).alias("content_hash"))
    errored = failed.select("page_id", "url", F.col("reason").alias("error"))
    return upsert.ok_error_union(ok, errored).select("page_id", "url", _text("content_hash"), _text("error"))


@query(
    "parser_chain",
    f"""WITH {RAW_BOOKMARKS} SELECT pos, CASE WHEN source = 'chrome' THEN url ELSE upper(url) END AS url,
      CASE WHEN source = 'edge' THEN 'none' ELSE '<' || coalesce(title, 'none') || '>' END AS title FROM raw_bookmarks""",
)
def _(spark, sf):
    parked = F.concat(F.lit("chrome-extension://x/s.html?url="), F.url_encode(F.col("url")))
    works = F.col("source").isin("chrome") & (F.instr("url", "://") > 0)
    rows = raw_bookmarks(spark, sf).select("pos", "source", F.when(works, parked).otherwise(F.upper("url")).alias("url"), "title")

    def louder(row: dict) -> dict | None:
        if row["source"] == "edge":
            return {**row, "title": None}
        return {**row, "title": f"<{row['title'] or 'none'}>"}

    def broken(row: dict) -> dict:
        return {**row, "title": row["title"][10_000_000]}

    def nothing(df):
        return None

    def fails(df):
        raise ValueError("this parser never works")

    chain = {
        "a_suspended_tabs": parsers.suspended_tabs,
        "b_louder": parsers.row_parser(louder),
        "c_broken": parsers.row_parser(broken),
        "d_nothing": nothing,
        "e_fails": fails,
    }
    return parsers.parser_chain(rows, chain).select("pos", "url", _text("title"))


@query(
    "ingest",
    f"""WITH {BOOKMARKS}, {RESPONSES}, {STORED_PAGES},
    fresh AS (SELECT * FROM bookmarks WHERE name <> '扩展程序' AND NOT regexp_matches(url, '^https?://10[.]0[.]')
      AND url NOT IN (SELECT url FROM stored_pages) QUALIFY row_number() OVER (PARTITION BY url ORDER BY pos) = 1),
    tried AS (SELECT f.pos, f.url, f.name, CASE WHEN r.status IS NULL THEN 'Request failed: no response' WHEN r.status >= 400 THEN 'Request failed: ' || r.status
        WHEN NOT contains(lower(content_type), 'text/') THEN 'Non-text content (Content-Type: ' || content_type || ')' END AS error,
        '<h1>' || {SQL_TITLE} || '</h1>' || chr(10) || chr(10) || {sql_clean(SQL_HTML_TEXT)} AS content
      FROM fresh f LEFT JOIN responses r ON r.url = f.url),
    ok AS (SELECT * FROM tried WHERE error IS NULL QUALIFY row_number() OVER (PARTITION BY content ORDER BY pos) = 1),
    rows AS (SELECT pos, url, name, content, 'none' AS error FROM ok UNION ALL SELECT pos, url, name, 'none', error FROM tried WHERE error IS NOT NULL)
    SELECT (SELECT max(key) FROM stored_pages) + row_number() OVER (ORDER BY pos) AS key, url, name, content, error FROM rows""",
)
def _(spark, sf):
    from pageloom.plans.ingest import ingest

    known = upsert.to_store_rows(stored_pages(spark, sf))
    done = ingest(bookmarks(spark, sf), responses(spark, sf), known, F.lit(CRAWLED).cast("timestamp"))
    return done.rows.select("key", "url", "name", _text("content"), _text("error"))
