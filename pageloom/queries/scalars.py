"""Scalar functions and filters."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F

from pageloom.functions import charsets, dates, encoding, html, text, urls
from pageloom.operators import content, filters, summaries
from pageloom.queries import query
from pageloom.queries.inputs import (
    AS_OF, BOOKMARKS, CRAWLED, RAW_BOOKMARKS, RESPONSES, SQL_DOMAIN, SQL_HTML_TEXT, SQL_TITLE, STORED,
    bookmarks, raw_bookmarks, responses, sql_clean, sql_strip, store, table,
)
from pageloom.search.index import search_doc_prepare


@query(
    "eligible_url_filter",
    f"WITH {BOOKMARKS} SELECT pos, url, name FROM bookmarks "
    "WHERE url <> '' AND type = 'url' AND name <> '扩展程序' AND NOT regexp_matches(url, '^https?://10[.]0[.]')",
)
def _(spark, sf):
    return filters.eligible_url_filter(bookmarks(spark, sf)).select("pos", "url", "name")


@query(
    "folder_filter",
    f"WITH {RAW_BOOKMARKS} SELECT pos, url, coalesce(folder, '') AS folder FROM raw_bookmarks "
    "WHERE url <> '' AND coalesce(folder, '') <> 'Extensions'",
)
def _(spark, sf):
    from pageloom.sources.bookmarks import bookmark_export_normalize

    return filters.folder_filter(bookmark_export_normalize(raw_bookmarks(spark, sf))).select("pos", "url", "folder")


def _parked(spark, sf):
    """URLs as parked tabs: encoded once or twice, without a parameter, without an address, or not parked at all."""
    once = F.url_encode(F.col("url"))
    return raw_bookmarks(spark, sf).select(
        "pos",
        F.when(F.col("source") == "chrome", F.concat(F.lit("chrome-extension://x/s.html?t=a+b&url="), once))
        .when(F.col("source") == "firefox", F.concat(F.lit("chrome-extension://x/s.html?url="), F.url_encode(once), F.lit("#f")))
        .when(F.col("source") == "edge", F.concat(F.lit("chrome-extension://x/s.html?other="), once))
        .when(F.col("source") == "safari", F.concat(F.lit("chrome-extension://x/s.html?url=nothing"), F.col("pos").cast("string")))
        .otherwise(F.col("url"))
        .alias("parked"),
    )


@query(
    "suspended_url_rewrite",
    f"""WITH {RAW_BOOKMARKS}, parked AS (SELECT pos, CASE source
      WHEN 'chrome' THEN 'chrome-extension://x/s.html?t=a+b&url=' || url_encode(url)
      WHEN 'firefox' THEN 'chrome-extension://x/s.html?url=' || url_encode(url_encode(url)) || '#f'
      WHEN 'edge' THEN 'chrome-extension://x/s.html?other=' || url_encode(url)
      WHEN 'safari' THEN 'chrome-extension://x/s.html?url=nothing' || pos ELSE url END AS parked FROM raw_bookmarks),
    once AS (SELECT pos, parked, url_decode(regexp_extract(parked, '^chrome-extension://[^#]*[?&]url=([^&#]+)', 1)) AS u FROM parked),
    twice AS (SELECT pos, parked, CASE WHEN contains(u, '://') THEN u ELSE url_decode(u) END AS u FROM once)
    SELECT pos, CASE WHEN starts_with(parked, 'chrome-extension://') AND contains(u, '://') THEN u ELSE parked END AS url FROM twice""",
)
def _(spark, sf):
    return _parked(spark, sf).select("pos", urls.suspended_url_rewrite(F.col("parked")).alias("url"))


_VIDEO = "'https://www.youtube.com/watch?v=' || left(sha256(url), 11)"


@query(
    "video_id_extract",
    f"""WITH {RAW_BOOKMARKS}, v AS (SELECT pos, CASE source WHEN 'chrome' THEN {_VIDEO} || '&t=1'
      WHEN 'firefox' THEN 'youtu.be/' || left(sha256(url), 11) WHEN 'edge' THEN 'https://x.org/?u=https://youtu.be/' || left(sha256(url), 11)
      ELSE url END AS url FROM raw_bookmarks)
    SELECT pos, coalesce(nullif(regexp_extract(url, '^(?:https?://)?(?:www\\.)?(?:youtube\\.com/watch\\?v=|youtu\\.be/)([A-Za-z0-9_-]{{11}})', 1), ''), 'none') AS video_id FROM v""",
)
def _(spark, sf):
    short = F.left(F.sha2("url", 256), F.lit(11))
    url = (
        F.when(F.col("source") == "chrome", F.concat(F.lit("https://www.youtube.com/watch?v="), short, F.lit("&t=1")))
        .when(F.col("source") == "firefox", F.concat(F.lit("youtu.be/"), short))
        .when(F.col("source") == "edge", F.concat(F.lit("https://x.org/?u=https://youtu.be/"), short))
        .otherwise(F.col("url"))
    )
    found = urls.video_id_extract(F.col("url"))
    return raw_bookmarks(spark, sf).withColumn("url", url).select("pos", F.coalesce(found, F.lit("none")).alias("video_id"))


@query(
    "site_route",
    f"""WITH {RAW_BOOKMARKS}, r AS (SELECT pos, CASE WHEN source = 'chrome' THEN 'https://www.zhihu.com/question/' || pos ELSE url END AS url FROM raw_bookmarks)
    SELECT pos, url, CASE WHEN contains(url, 'zhihu.com') THEN 'selenium' ELSE 'requests' END AS method FROM r""",
)
def _(spark, sf):
    url = F.when(F.col("source") == "chrome", F.concat(F.lit("https://www.zhihu.com/question/"), F.col("pos").cast("string")))
    rows = raw_bookmarks(spark, sf).select("pos", url.otherwise(F.col("url")).alias("url"))
    return rows.select("pos", "url", urls.site_route(F.col("url")).alias("method"))


_IS_TEXT = "(contains(lower(content_type), 'text/html') OR contains(lower(content_type), 'text/plain'))"


@query(
    "content_type_filter",
    f"""WITH {RESPONSES} SELECT page_id, url, CASE WHEN {_IS_TEXT} THEN 'ok'
      ELSE 'Non-text content (Content-Type: ' || content_type || ')' END AS outcome FROM responses""",
)
def _(spark, sf):
    ok, failed = filters.content_type_filter(responses(spark, sf))
    return ok.select("page_id", "url", F.lit("ok").alias("outcome")).unionByName(
        failed.select("page_id", "url", F.col("reason").alias("outcome"))
    )


@query("html_title_extract", f"SELECT page_id, {SQL_TITLE} AS title FROM pages")
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.html_title_extract(F.col("html")).alias("title"))


@query("html_text_extract", f"SELECT page_id, {sql_clean(SQL_HTML_TEXT)} AS text FROM pages")
def _(spark, sf):
    extracted = html.html_text_extract(F.col("html"))
    return table(spark, sf, "pages").select("page_id", text.clean_text(extracted).alias("text"))


_ARTICLE = "regexp_replace(regexp_extract(html, '(?is)<article[^>]*>(.*?)</article>', 1), '<[^>]*>', chr(1), 'g')"


def _article_sql() -> str:
    from pageloom.queries.inputs import sql_entities

    node = sql_strip("n")
    nodes = f"list_transform(string_split({sql_entities(_ARTICLE)}, chr(1)), lambda n: {node})"
    return f"SELECT page_id, array_to_string({nodes}, '') AS text FROM pages"


@query("article_extract", _article_sql())
def _(spark, sf):
    return table(spark, sf, "pages").select("page_id", html.article_extract(F.col("html")).alias("text"))


@query("clean_text", f"SELECT doc_id, {sql_clean('text')} AS text FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.clean_text(F.col("text")).alias("text"))


_LETTERS = "abcdefghijklmnopqrstuvwxyz"
_FOREIGN = "éèêëàâäáãåíìîïóòôöõúùûüñçý"
_ACCENTED = f"CASE WHEN lang = 'de' THEN translate(text, '{_LETTERS}', '{_FOREIGN}') ELSE text END"
_SUSPECT = (
    "length(t) >= 20 AND length(regexp_replace(t, '[\\x00-\\x7F]', '', 'g')) >= length(t) * 0.1 "
    "AND regexp_matches(t, '[^\\x00-\\x7F]{10}')"
)


def _accented(spark, sf):
    swapped = F.translate("text", _LETTERS, _FOREIGN)
    return table(spark, sf, "documents").select("doc_id", F.when(F.col("lang") == "de", swapped).otherwise(F.col("text")).alias("t"))


@query("encoding_suspect", f"SELECT doc_id, coalesce({_SUSPECT}, false) AS suspect FROM (SELECT doc_id, {_ACCENTED} AS t FROM documents)")
def _(spark, sf):
    return _accented(spark, sf).select("doc_id", encoding.encoding_suspect(F.col("t")).alias("suspect"))


def _garbled_sql(text_sql: str) -> str:
    """Text as it looks when its UTF-8 bytes are read as Latin-1 (two-byte characters)."""
    char = "CASE WHEN unicode(c) >= 128 THEN chr(192 + unicode(c) // 64) || chr(128 + unicode(c) % 64) ELSE c END"
    return f"array_to_string(list_transform(string_split({text_sql}, ''), lambda c: {char}), '')"


@query(
    "encoding_repair",
    f"""WITH a AS (SELECT doc_id, {_ACCENTED} AS original FROM documents),
    g AS (SELECT doc_id, original, {_garbled_sql("original")} AS t FROM a)
    SELECT doc_id, CASE WHEN {_SUSPECT} THEN original ELSE t END AS text FROM g""",
)
def _(spark, sf):
    # Latin-1 has a character for every byte, so nothing is lost on the way.
    garbled = F.decode(F.encode("t", "UTF-8"), "ISO-8859-1")
    rows = _accented(spark, sf).withColumn("t", garbled)
    return rows.select("doc_id", encoding.encoding_repair(F.col("t"), "utf-8").alias("text"))


_SPOILING = ("latin-1", "utf-8", "cp850", "hp-roman8")


def _spoilt(doc_id: int, text: str | None) -> str | None:
    """A long text decoded as Latin-1 from the charset of its number, where that leaves a text that looks wrong."""
    try:
        bad = text.encode(_SPOILING[doc_id % 4]).decode("latin-1") if text and len(text) >= 200 else text
    except UnicodeEncodeError:
        return text
    foreign = sum(c > "\x7f" for c in bad or "")
    return bad if bad and foreign >= len(bad) * 0.1 and re.search(r"[^\x00-\x7f]{10}", bad) else text


@query("encoding_repair_any", f"SELECT doc_id, t AS text FROM (SELECT doc_id, {_ACCENTED} AS t FROM documents)")
def _(spark, sf):
    """Long texts in accented letters, wrongly decoded from three charsets by turns or left as they are: each comes back."""
    rows = _accented(spark, sf)
    model = charsets.fit_charsets(rows, "t", _SPOILING)
    spoil = F.pandas_udf(lambda ids, texts: pd.Series([_spoilt(i, t) for i, t in zip(ids, texts)]), "string", F.PandasUDFType.SCALAR)
    bad = rows.select("doc_id", spoil("doc_id", "t").alias("bad"))
    return bad.select("doc_id", charsets.encoding_repair_any(F.col("bad"), model, bad).alias("text"))


_TEXTS = f"""texts AS (SELECT page_id, url, content_type, CASE WHEN content_type = 'text/plain' THEN 'No Title' ELSE {SQL_TITLE} END AS html_title,
  CASE WHEN contains(content_type, 'image') OR content_type = 'text/plain' AND status = 500 THEN '' ELSE {sql_clean(SQL_HTML_TEXT)} END AS text FROM responses)"""


def _texts(spark, sf):
    """Extracted pages, some without a title, some without text."""
    empty = F.contains("content_type", F.lit("image")) | ((F.col("content_type") == "text/plain") & (F.col("status") == 500))
    return responses(spark, sf).select(
        "page_id", "url", "content_type",
        F.when(F.col("content_type") == "text/plain", "No Title").otherwise(html.html_title_extract(F.col("html"))).alias("html_title"),
        F.when(empty, "").otherwise(text.clean_text(html.html_text_extract(F.col("html")))).alias("text"),
    )


_COMPOSED = "CASE WHEN html_title <> 'No Title' THEN '<h1>' || html_title || '</h1>' || chr(10) || chr(10) || text ELSE text END"


@query(
    "content_compose",
    f"""WITH {RESPONSES}, {_TEXTS} SELECT page_id, {_COMPOSED} AS content,
      CASE WHEN html_title = 'No Title' AND text = '' THEN 'Extracted content is empty and no HTML title available' ELSE 'ok' END AS outcome FROM texts""",
)
def _(spark, sf):
    ok, failed = content.content_compose(_texts(spark, sf))
    return ok.select("page_id", "content", F.lit("ok").alias("outcome")).unionByName(
        failed.select("page_id", "content", F.col("reason").alias("outcome"))
    )


@query(
    "rendered_fallback",
    f"""WITH {RESPONSES}, {_TEXTS}, said AS (SELECT conv_id, string_agg(text, chr(10) ORDER BY turn, text) AS text FROM conversations GROUP BY conv_id),
    rendered AS (SELECT p.url, coalesce(said.text, ' abc ') AS rendered_text FROM pages p LEFT JOIN said ON conv_id = page_id)
    SELECT page_id, CASE WHEN t.text <> '' THEN t.text WHEN length({sql_strip("rendered_text")}) >= 5 THEN rendered_text ELSE '' END AS text,
      CASE WHEN t.text <> '' THEN 'requests' ELSE 'selenium' END AS crawl_method FROM texts t JOIN rendered USING (url)""",
)
def _(spark, sf):
    turns = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("turns"))
    lines = F.transform(F.filter("turns", lambda t: t["text"].isNotNull()), lambda t: t["text"])
    said = turns.select("conv_id", F.when(F.size(lines) > 0, F.array_join(lines, "\n")).alias("text"))
    rendered = table(spark, sf, "pages").join(said, F.col("conv_id") == F.col("page_id"), "left").select(
        "url", F.coalesce("text", F.lit(" abc ")).alias("rendered_text")
    )
    return content.rendered_fallback(_texts(spark, sf), rendered).select("page_id", "text", "crawl_method")


@query(
    "content_enrich",
    f"""WITH {RESPONSES}, {_TEXTS} SELECT page_id, coalesce(nullif(html_title, 'No Title'), 'No Title') AS title, length({_COMPOSED}) AS content_length,
      sha256({_COMPOSED}) AS content_hash, '{CRAWLED}' AS crawl_time, 'requests' AS crawl_method FROM texts
      WHERE html_title <> 'No Title' OR text <> ''""",
)
def _(spark, sf):
    ok, _failed = content.content_compose(_texts(spark, sf))
    rows = ok.withColumn("name", F.when(F.col("html_title") != "No Title", F.col("html_title")))
    enriched = content.content_enrich(rows, F.lit(CRAWLED).cast("timestamp"))
    when = F.date_format("crawl_time", "yyyy-MM-dd HH:mm:ss").alias("crawl_time")
    return enriched.select("page_id", "title", "content_length", "content_hash", when, "crawl_method")


@query("domain_extract", f"WITH {RAW_BOOKMARKS} SELECT pos, {SQL_DOMAIN} AS domain FROM raw_bookmarks")
def _(spark, sf):
    return raw_bookmarks(spark, sf).select("pos", urls.domain_extract(F.col("url")).alias("domain"))


@query("date_extract", f"WITH {STORED} SELECT key, CAST(date AS VARCHAR) AS date FROM stored")
def _(spark, sf):
    day = dates.date_extract(F.col("date_added"), F.col("crawl_time"), F.lit(AS_OF))
    return store(spark, sf).select("key", day.cast("string").alias("date"))


_KEY = f"CASE WHEN guid <> 'N/A' THEN guid WHEN id <> 'N/A' THEN id ELSE {sql_strip('url')} END"


@query("search_key", f"WITH {STORED} SELECT key, {_KEY} AS search_key FROM stored")
def _(spark, sf):
    return store(spark, sf).select("key", urls.search_key(F.col("guid"), F.col("id"), F.col("url")).alias("search_key"))


_BODY = "coalesce(content, '') || chr(10) || chr(10) || coalesce(description, '')"
SEARCH_DOCS = (
    STORED
    + f""", prepared AS (SELECT key AS pos, {_KEY} AS key, {sql_strip("coalesce(title, name)")} AS title, url,
    {_BODY} AS content,
    {sql_strip("coalesce(summary, '')")} AS summary FROM stored),
docs AS (SELECT *, title || ' ' || content || ' ' || summary AS composite_text FROM prepared)"""
)


@query(
    "search_doc_prepare",
    f"""WITH {SEARCH_DOCS} SELECT key, title, url, CASE WHEN length(content) > 10000 THEN left(content, 10000) || '...' ELSE content END AS content,
      summary FROM docs""",
)
def _(spark, sf):
    return search_doc_prepare(store(spark, sf), max_chars=10_000).select("key", "title", "url", "content", "summary")


@query("search_doc_prepare_whole", f"WITH {SEARCH_DOCS} SELECT key, title, url, content, summary FROM docs")
def _(spark, sf):
    return search_doc_prepare(store(spark, sf)).select("key", "title", "url", "content", "summary")


@query(
    "composite_text",
    f"WITH {STORED} SELECT key, coalesce(title, '') || ' ' || coalesce(content, '') || ' ' || coalesce(summary, '') AS composite_text FROM stored",
)
def _(spark, sf):
    return store(spark, sf).select("key", text.composite_text(F.col("title"), F.col("content"), F.col("summary")).alias("composite_text"))


@query(
    "prompt_build",
    f"""WITH {STORED} SELECT key, 'T=' || coalesce(title, name) || ' U=' || url || ' C=' ||
      CASE WHEN length(content) > 6000 THEN left(content, 6000) || '...' ELSE content END AS prompt FROM stored WHERE content IS NOT NULL""",
)
def _(spark, sf):
    rows = store(spark, sf).where("content IS NOT NULL")
    return summaries.prompt_build(rows, "T={title} U={url} C={content}", max_chars=6000).select("key", "prompt")


@query(
    "prompt_build_whole",
    f"WITH {STORED} SELECT key, 'T=' || coalesce(title, name) || ' U=' || url || ' C=' || content AS prompt FROM stored WHERE content IS NOT NULL",
)
def _(spark, sf):
    rows = store(spark, sf).where("content IS NOT NULL")
    return summaries.prompt_build(rows, "T={title} U={url} C={content}").select("key", "prompt")


@query("url_hash", f"WITH {RAW_BOOKMARKS} SELECT pos, sha256(url) AS url_hash FROM raw_bookmarks")
def _(spark, sf):
    return raw_bookmarks(spark, sf).select("pos", urls.url_hash(F.col("url")).alias("url_hash"))


@query("content_hash", "SELECT doc_id, sha256(text) AS content_hash FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))
