"""From extracted text to the stored content column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import is_blank, strip
from pageloom.functions.urls import PLAIN, RENDERED
from pageloom.operators.joins import with_content_hash
from pageloom.schema import NO_TITLE, REASON_EMPTY

# Fixed value: fewest characters a rendered page must have.
MIN_RENDERED_CHARS = 5


def usable_rendered(text: Column) -> Column:
    """Rendered text that is long enough, else NULL."""
    return F.when(F.length(strip(text)) >= MIN_RENDERED_CHARS, text)


def has_title(html_title: Column) -> Column:
    """True for a page with a title of its own."""
    return ~F.coalesce(html_title, F.lit("")).isin("", NO_TITLE)


def composed(html_title: Column, text: Column) -> Column:
    """Content of a page: the title as a heading, then the text."""
    body = F.coalesce(text, F.lit(""))
    heading = F.concat(F.lit("<h1>"), html_title, F.lit("</h1>\n\n"))
    return F.when(has_title(html_title), F.concat(heading, body)).otherwise(body)


def rendered_fallback(df: DataFrame, rendered: DataFrame) -> DataFrame:
    """Blank ``text`` is replaced by the rendered page's text of the same URL.

    ``rendered(url, rendered_text)`` has one row per URL. Only blank pages go
    into the join; the others pass by.
    """
    blank = is_blank(F.col("text"))
    usable = rendered.select("url", usable_rendered(F.col("rendered_text")).alias("rendered_text"))
    filled = (
        df.where(blank)
        .join(usable, "url", "left")
        .withColumn("text", F.coalesce("rendered_text", F.lit("")))
        .withColumn("crawl_method", F.lit(RENDERED))
        .drop("rendered_text")
    )
    plain = df.where(~blank)
    if "crawl_method" not in df.columns:
        plain = plain.withColumn("crawl_method", F.lit(PLAIN))
    return plain.unionByName(filled)


def content_compose(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Prefix ``text`` with the page title; a page with neither is a failure."""
    title, text = F.col("html_title"), F.col("text")
    with_content = df.withColumn("content", composed(title, text))
    empty = ~has_title(title) & is_blank(text)
    return with_content.where(~empty), with_content.where(empty).withColumn("reason", F.lit(REASON_EMPTY))


def content_enrich(df: DataFrame, crawl_time: Column) -> DataFrame:
    """Add title, content length and hash, crawl time and crawl method."""
    enriched = with_content_hash(df).withColumns(
        {
            "title": F.coalesce(F.col("name"), F.lit(NO_TITLE)),
            "content_length": F.length("content"),
            "crawl_time": crawl_time,
        }
    )
    if "crawl_method" not in df.columns:
        enriched = enriched.withColumn("crawl_method", F.lit(PLAIN))
    return enriched
