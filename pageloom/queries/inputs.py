"""How the given tables play the parts of bookmarks, responses and stored rows.

Every input is there twice, as DataFrame and as SQL (names in capitals).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from pageloom.functions.dates import date_extract, epoch_text, iso_text
from pageloom.functions.html import html_title_extract
from pageloom.functions.text import content_hash
from pageloom.functions.urls import domain_extract, url_hash
from pageloom.operators.upsert import to_store_rows
from pageloom.session import scratch_path

AS_OF = "2024-06-01"
CRAWLED = "2024-07-01 12:00:00"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def by_event(cases: dict[str, object], otherwise=None):
    """A value that depends on the kind of event."""
    out = F.lit(otherwise)
    for kind, value in cases.items():
        out = F.when(F.col("event_type") == kind, value).otherwise(out)
    return out


BROWSER = {"click": "chrome", "view": "firefox", "purchase": "edge", "signup": "safari", "error": "brave"}


def raw_bookmarks(spark: SparkSession, sf: str) -> DataFrame:
    """Each event is a bookmark of a page: ``pos, ts, url, title, folder, source``."""
    pages = table(spark, sf, "pages").select("page_id", "url", html_title_extract(F.col("html")).alias("page_title"))
    events = table(spark, sf, "events").drop("props")
    url = (
        F.when(F.col("value") < 2, F.lit(""))
        .when(F.col("value") < 5, F.concat(F.lit("http://10.0.3."), F.col("user_id").cast("string")))
        .when(F.col("value") < 8, F.concat(F.lit("http://10.1.3."), F.col("user_id").cast("string")))
        .otherwise(F.col("url"))
    )
    title = F.when(F.col("value") < 40, F.when(F.col("event_type") != "error", F.lit("扩展程序"))).otherwise(F.col("page_title"))
    return events.join(pages, F.col("user_id") == F.col("page_id")).select(
        F.col("event_id").alias("pos"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("ts"),
        url.alias("url"),
        title.alias("title"),
        by_event({"click": "Reading", "view": "Extensions", "purchase": "Work"}).alias("folder"),
        by_event(BROWSER).alias("source"),
    )


_STRIP = r"'^[\s\x0b\x85\p{Z}]+|[\s\x0b\x85\p{Z}]+$'"


def sql_strip(text: str) -> str:
    return f"regexp_replace({text}, {_STRIP}, '', 'g')"


def sql_entities(text: str) -> str:
    for entity, char in (("&quot;", '"'), ("&middot;", "·"), ("&copy;", "©"), ("&amp;", "&")):
        text = f"replace({text}, '{entity}', '{char}')"
    return text


SQL_TITLE = sql_strip(sql_entities("regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"))
SQL_TITLE = f"CASE WHEN {SQL_TITLE} = '' THEN 'No Title' ELSE {SQL_TITLE} END"


def _sql_tags(text: str) -> str:
    text = f"regexp_replace({text}, '(?s)<!--.*?-->', chr(10), 'g')"
    for tag in ("script", "style", "nav", "footer", "header"):
        text = f"regexp_replace({text}, '(?is)<{tag}[ >].*?</{tag}>|<{tag}></{tag}>', chr(10), 'g')"
    return f"regexp_replace({text}, '<[^>]*>', chr(10), 'g')"


SQL_HTML_TEXT = sql_entities(_sql_tags("html"))


def sql_clean(text: str) -> str:
    line = sql_strip("l")
    return f"array_to_string(list_filter(list_transform(string_split({text}, chr(10)), lambda l: {line}), lambda l: l <> ''), chr(10))"


SQL_DOMAIN = r"regexp_replace(lower(regexp_extract(url, '^(?:[A-Za-z][A-Za-z0-9+.-]*:)?//([^/?#]*)', 1)), '^www[.]', '')"


RAW_BOOKMARKS = f"""raw_bookmarks AS (
  SELECT event_id AS pos, CASE WHEN event_type <> 'signup' THEN ts END AS ts,
    CASE WHEN value < 2 THEN '' WHEN value < 5 THEN 'http://10.0.3.' || user_id
         WHEN value < 8 THEN 'http://10.1.3.' || user_id ELSE url END AS url,
    CASE WHEN value < 40 THEN CASE WHEN event_type <> 'error' THEN '扩展程序' END ELSE {SQL_TITLE} END AS title,
    CASE event_type WHEN 'click' THEN 'Reading' WHEN 'view' THEN 'Extensions' WHEN 'purchase' THEN 'Work' END AS folder,
    CASE event_type WHEN 'click' THEN 'chrome' WHEN 'view' THEN 'firefox' WHEN 'purchase' THEN 'edge'
         WHEN 'signup' THEN 'safari' WHEN 'error' THEN 'brave' END AS source
  FROM events JOIN pages ON user_id = page_id)"""

SQL_ISO = (
    "CASE WHEN strftime(ts, '%f') = '000000' THEN strftime(ts, '%Y-%m-%dT%H:%M:%S') "
    "ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') END"
)
SQL_EPOCH = "(epoch_us(ts) // 1000000) || '.' || lpad(CAST(epoch_us(ts) % 1000000 AS VARCHAR), 6, '0')"

BOOKMARKS = (
    RAW_BOOKMARKS
    + f""", bookmarks AS (
  SELECT pos, url, title AS name, 'url' AS type, coalesce({SQL_ISO}, 'N/A') AS date_added, folder, source
  FROM raw_bookmarks WHERE url <> '' AND title <> '')"""
)


def bookmarks(spark: SparkSession, sf: str) -> DataFrame:
    from pageloom.sources.bookmarks import bookmark_normalize

    return bookmark_normalize(raw_bookmarks(spark, sf))


CONTENT_TYPES = {"signup": "application/pdf", "error": "TEXT/HTML; charset=utf-8", "click": "text/html", "view": "text/plain", "purchase": "image/png"}


def responses(spark: SparkSession, sf: str) -> DataFrame:
    """Fetched pages ``page_id, url, html, content_type, status``; the event of the page's number says how it went."""
    events = table(spark, sf, "events").select("event_id", "event_type", "value")
    return table(spark, sf, "pages").join(events, F.col("event_id") == F.col("page_id")).select(
        "page_id", "url", "html",
        by_event(CONTENT_TYPES).alias("content_type"),
        F.when(F.col("value") > 150, 500).otherwise(200).alias("status"),
    )


RESPONSES = """responses AS (
  SELECT page_id, url, html,
    CASE event_type WHEN 'signup' THEN 'application/pdf' WHEN 'error' THEN 'TEXT/HTML; charset=utf-8'
      WHEN 'click' THEN 'text/html' WHEN 'view' THEN 'text/plain' WHEN 'purchase' THEN 'image/png' END AS content_type,
    CASE WHEN value > 150 THEN 500 ELSE 200 END AS status
  FROM pages JOIN events ON event_id = page_id)"""


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """Stored rows in the columns of the store, one per document."""
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    events = table(spark, sf, "events").select("event_id", "event_type", "ts")
    rows = docs.join(events, F.col("event_id") == F.col("doc_id"), "left")
    doc_id = F.col("doc_id").cast("string")
    toxic = F.coalesce(F.col("toxic"), F.lit(0)) == 1
    content = F.when(~toxic, F.col("text"))
    added = by_event(
        {
            "click": iso_text(F.col("ts")),
            "view": F.date_format("ts", "yyyy-MM-dd"),
            "error": F.lit("N/A"),
            "purchase": epoch_text(F.col("ts")),
        }
    )
    place = F.concat(F.col("source"), F.lit(".example.com/"), F.col("lang"), F.lit("/"), doc_id)
    rows = rows.select(
        (F.col("doc_id") + 1).alias("key"),
        F.concat(F.lit("https://"), F.when(F.col("lang") == "en", "www.").otherwise(""), place).alias("url"),
        F.concat("source", F.lit(" "), "lang").alias("name"),
        F.when(F.coalesce(F.col("quality"), F.lit(1)) == 1, F.concat(F.lit(" Page "), doc_id, F.lit(" of "), "source")).alias("title"),
        F.lit("url").alias("type"),
        F.col("source").alias("folder"),
        by_event({"click": F.concat(F.lit("guid-"), doc_id)}, "N/A").alias("guid"),
        by_event({"view": F.concat(F.lit("id-"), doc_id)}, "N/A").alias("id"),
        added.alias("date_added"),
        F.when(F.col("quality") == 1, F.concat(F.lit("About "), "source")).alias("description"),
        content.alias("content"),
        F.length(content).alias("content_length"),
        content_hash(content).alias("content_hash"),
        F.when(F.col("event_type") != "signup", F.col("ts")).alias("crawl_time"),
        F.when(toxic, None).when(F.col("lang") == "fr", "selenium").otherwise("requests").alias("crawl_method"),
        F.when(toxic, "Request failed: 500").alias("error"),
        F.when(F.col("quality") == 1, F.concat(F.lit("Summary of "), "source", F.lit(" in "), "lang"))
        .when(F.col("quality") == 0, "  ")
        .alias("summary"),
    )
    rows = rows.withColumns(
        {
            "url_hash": url_hash(F.col("url")),
            "domain": domain_extract(F.col("url")),
            "date": date_extract(F.col("date_added"), F.col("crawl_time"), F.lit(AS_OF)),
        }
    )
    return to_store_rows(rows)


STORED = f"""stored0 AS (
  SELECT doc_id + 1 AS key,
    'https://' || CASE WHEN lang = 'en' THEN 'www.' ELSE '' END || source || '.example.com/' || lang || '/' || doc_id AS url,
    source || ' ' || lang AS name, CASE WHEN coalesce(quality, 1) = 1 THEN ' Page ' || doc_id || ' of ' || source END AS title,
    'url' AS type, source AS folder,
    CASE WHEN event_type = 'click' THEN 'guid-' || doc_id ELSE 'N/A' END AS guid,
    CASE WHEN event_type = 'view' THEN 'id-' || doc_id ELSE 'N/A' END AS id,
    CASE event_type WHEN 'click' THEN {SQL_ISO} WHEN 'view' THEN strftime(ts, '%Y-%m-%d') WHEN 'error' THEN 'N/A'
      WHEN 'purchase' THEN {SQL_EPOCH} END AS date_added,
    CASE WHEN quality = 1 THEN 'About ' || source END AS description,
    CASE WHEN coalesce(toxic, 0) = 0 THEN text END AS content,
    CASE WHEN event_type <> 'signup' THEN ts END AS crawl_time,
    CASE WHEN coalesce(toxic, 0) = 1 THEN NULL WHEN lang = 'fr' THEN 'selenium' ELSE 'requests' END AS crawl_method,
    CASE WHEN coalesce(toxic, 0) = 1 THEN 'Request failed: 500' END AS error,
    CASE quality WHEN 1 THEN 'Summary of ' || source || ' in ' || lang WHEN 0 THEN '  ' END AS summary
  FROM documents LEFT JOIN labels USING (doc_id) LEFT JOIN events ON event_id = doc_id),
stored AS (
  SELECT *, length(content) AS content_length, sha256(content) AS content_hash, sha256(url) AS url_hash,
    {SQL_DOMAIN} AS domain,
    coalesce(CASE WHEN date_added <> 'N/A' AND (date_added LIKE '%T%' OR regexp_matches(date_added, '^[0-9]{{4}}-[0-9][0-9]-[0-9][0-9]$'))
      THEN try_cast(left(date_added, 10) AS DATE) END, CAST(crawl_time AS DATE), DATE '{AS_OF}') AS date
  FROM stored0)"""


_folders: dict[tuple[str, str, str], str] = {}


def once(spark: SparkSession, sf: str, name: str, make) -> str:
    """Path of something written once per session and data set; ``make(path)`` writes it."""
    slot = (spark.sparkContext.applicationId, sf, name)
    if slot not in _folders:
        path = scratch_path(spark, name)
        make(path)
        _folders[slot] = path
    return _folders[slot]


def store_path(spark: SparkSession, sf: str) -> str:
    from pageloom.sources.store import store_replace

    return once(spark, sf, "store", lambda path: store_replace(stored(spark, sf), path))


def store(spark: SparkSession, sf: str) -> DataFrame:
    """The store as a table on disk, the way later runs find it."""
    from pageloom.sources.store import store_scan

    return store_scan(spark, store_path(spark, sf))
