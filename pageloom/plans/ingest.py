"""Bookmarks and fetched pages into the store."""

from __future__ import annotations

from collections.abc import Callable, Collection
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from pageloom.functions.dates import date_extract
from pageloom.functions.encoding import encoding_repair
from pageloom.functions.html import html_text_extract, html_title_extract
from pageloom.functions.text import clean_text, is_blank
from pageloom.functions.urls import PLAIN, RENDERED, site_route
from pageloom.operators.content import composed, content_enrich, has_title, usable_rendered
from pageloom.operators.dedup import content_dedup, url_dedup
from pageloom.operators.filters import eligible_url_filter, is_text_type, non_text_reason
from pageloom.operators.joins import concerned, content_antijoin, incremental_url_antijoin, unmet, with_content_hash, with_url_hash
from pageloom.operators.numbering import first_per, number_rows
from pageloom.operators.ordering import crawl_limit
from pageloom.operators.parsers import Parser, parser_chain
from pageloom.operators.sizing import BROADCAST_ROWS, few_values, holds_at_most, local_column, small_side
from pageloom.operators.stats import run_summary
from pageloom.operators.upsert import next_key, ok_error_union, to_store_rows
from pageloom.schema import FAILURE, REASON_EMPTY, REASON_RENDERED_SITE, REASON_REQUEST, STORE
from pageloom.session import staged
from pageloom.sources.failures import failed_append
from pageloom.sources.filters import LOOKED_UP
from pageloom.sources.seen import seen_append, seen_scan
from pageloom.sources.store import last_key, store_append, store_near

#: ``lookup(hashes, column)``: stored rows among which are all that share a hash with the batch.
Lookup = Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Ingested:
    """``rows`` for the store with keys, ``failures``, the one-row ``counts``, and ``tried``, the hashes of all URLs that were looked at.

    ``nothing`` says that all were known: then rows, failures and tried are empty.
    """

    rows: DataFrame
    failures: DataFrame
    counts: DataFrame
    tried: DataFrame
    nothing: bool = False


def new_bookmarks(
    bookmarks: DataFrame,
    store: DataFrame,
    parsers: dict[str, Parser] | None = None,
    small: bool | None = None,
    lookup: Lookup | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Eligible bookmarks, and of those the first per URL that the store lacks.

    Parsers may change the URL, so they run before the URL decides. What the
    store knows under the URL as it came does not reach them.
    """

    def unknown(df: DataFrame) -> DataFrame:
        hashed = with_url_hash(df)
        return incremental_url_antijoin(hashed, store if lookup is None else lookup(hashed, "url_hash"), small)

    eligible = eligible_url_filter(bookmarks)
    candidates = eligible
    if parsers:
        candidates = parser_chain(unknown(eligible), parsers).drop("url_hash")
    # First wins before the anti join: a URL with very many copies enters it once.
    return eligible, unknown(url_dedup(candidates))


def extract_pages(pages: DataFrame, charset: str | None = None) -> DataFrame:
    """Title and clean text of each response, repaired when a ``charset`` is named; the markup goes no further."""
    readable = is_text_type(F.col("content_type"))
    html = F.when(readable, F.col("html"))
    found = pages.select(
        "page_id",
        "url",
        "content_type",
        "status",
        readable.alias("readable"),
        F.when(readable, html_title_extract(html)).alias("html_title"),
        html_text_extract(html).alias("text"),
    )
    if charset:
        # Before the cleaning, which takes some bytes of a text decoded wrongly for white space.
        found = found.withColumns({c: encoding_repair(F.col(c), charset) for c in ("html_title", "text")})
    return found.withColumn("text", clean_text(F.col("text")))


def attempt(
    bookmarks: DataFrame, pages: DataFrame, rendered: DataFrame | None = None, small: bool | None = None, charset: str | None = None
) -> DataFrame:
    """Every bookmark with its ``content`` and ``crawl_method``, or the ``reason`` there is none.

    Pages are reduced to those of the bookmarks, one for each address, before anything is extracted from them.
    """
    wanted = first_per(concerned(pages, bookmarks, "url", small), "url", F.col("page_id"))
    responses = extract_pages(wanted, charset).drop("page_id")
    joined = bookmarks.join(responses, "url", "left")
    if rendered is None:
        joined = joined.withColumn("rendered_text", F.lit(None).cast("string"))
    else:
        shown = F.col("rendered_text") if charset is None else encoding_repair(F.col("rendered_text"), charset)
        joined = joined.join(rendered.select("url", usable_rendered(shown).alias("rendered_text")), "url", "left")
    by_browser = site_route(F.col("url")) == RENDERED
    unanswered = F.col("status").isNull() | (F.col("status") >= 400)
    blank = is_blank(F.col("text"))
    head, _, _ = REASON_REQUEST.partition("%s")
    reason = (
        F.when(by_browser, F.when(F.col("rendered_text").isNull(), REASON_RENDERED_SITE))
        .when(unanswered, F.concat(F.lit(head), F.coalesce(F.col("status").cast("string"), F.lit("no response"))))
        .when(~F.col("readable"), non_text_reason(F.col("content_type")))
        .when(blank & F.col("rendered_text").isNull() & ~has_title(F.col("html_title")), REASON_EMPTY)
    )
    use_rendered = by_browser | blank
    text = F.when(use_rendered, F.col("rendered_text")).otherwise(F.col("text"))
    found = joined.withColumns(
        {
            "reason": reason,
            "content": composed(F.col("html_title"), text),
            "crawl_method": F.when(use_rendered, RENDERED).otherwise(PLAIN),
        }
    )
    return with_content_hash(found).drop("html_title", "text", "rendered_text", "readable", "content_type", "status")


def ingest(
    bookmarks: DataFrame,
    pages: DataFrame,
    store: DataFrame | None,
    crawl_time: Column,
    rendered: DataFrame | None = None,
    parsers: dict[str, Parser] | None = None,
    skip_unreachable: bool = False,
    limit: int | None = None,
    charset: str | None = None,
    seen: DataFrame | None = None,
    lookup: Lookup | None = None,
    last: int | None = None,
) -> Ingested:
    """One run: filter, parse, skip known URLs, extract, skip known content, give keys.

    Known are URLs of the store and, where it is given, those of ``seen(url_hash)``. With a ``charset``, titles and texts that look wrongly decoded are repaired on the way.
    The outcome of every bookmark is staged once; rows, failures and counts are
    then read from it, and the long plan is not run again for each of them. One
    count of the bookmarks tells all joins with the store whether the run is
    small beside it. With a ``lookup`` only rows of the store that it gives for a batch are compared, ``last`` has to say the
    highest key of the store, and the ``store`` itself is not needed. The hashes of few URLs are then compared before anything else is read of
    their rows, and what is decided by hashes alone is decided in one task.
    """
    eligible = eligible_url_filter(bookmarks)
    asked = None if lookup is None or parsers else few_values(with_url_hash(eligible), "url_hash", LOOKED_UP)
    few = asked is not None
    if few:
        small = True
        new = asked if seen is None else unmet(asked, seen, "url_hash")
        new = unmet(new, lookup(local_column(bookmarks.sparkSession, new, "url_hash"), "url_hash"), "url_hash") if new else new
        if not new:
            return _nothing(eligible)
        wanted = F.broadcast(local_column(bookmarks.sparkSession, new, "url_hash"))
        fresh = url_dedup(with_url_hash(eligible).join(wanted, "url_hash", "left_semi"))
        pages = with_url_hash(pages).join(wanted, "url_hash", "left_semi")
    else:
        small = holds_at_most(bookmarks.select("url"), BROADCAST_ROWS)
        eligible, fresh = new_bookmarks(bookmarks, store, parsers, small, lookup)
        if seen is not None:
            fresh = incremental_url_antijoin(fresh, seen, small)
    # Pages of few URLs were picked above.
    found = attempt(fresh, pages, rendered, small and not few, charset)
    outcome = staged(found, "outcome")

    def narrow(df: DataFrame) -> DataFrame:
        """A few rows without texts go into one task, and need no shuffle there."""
        return df.coalesce(1) if few else df

    hashes = narrow(outcome.select("pos", "url_hash", "content_hash", "reason"))
    same_contents = store if lookup is None else lookup(hashes, "content_hash")
    if limit:
        # The run ends with the row that fills the limit: what comes later was never tried.
        kept = content_antijoin(content_dedup(outcome.where("reason IS NULL").drop("reason")), same_contents, small).select("pos")
        counted = kept if skip_unreachable else kept.union(outcome.where("reason IS NOT NULL").select("pos"))
        ends = crawl_limit(counted, limit).agg(F.max("pos"), F.count(F.lit(1))).first()
        if ends[1] == limit:
            outcome, hashes = (df.where(F.col("pos") <= ends[0]) for df in (outcome, hashes))
    # Which rows stay, and their keys, follow from hashes and positions. The store has none of these URLs, so all keys are new.
    stay = content_antijoin(content_dedup(hashes.where("reason IS NULL")), same_contents, small).select("pos", "url_hash")
    if not skip_unreachable:
        stay = stay.union(hashes.where("reason IS NOT NULL").select("pos", "url_hash"))
    stay = narrow(staged(narrow(stay), "stay"))
    first = next_key(store) if last is None else F.lit(last)
    keys = number_rows(stay, "pos", "key").select("url_hash", (F.col("key") + first).alias("key"))
    found = outcome.join(small_side(keys, small=small), "url_hash")
    ok = content_enrich(found.where("reason IS NULL").drop("reason"), crawl_time)
    failed = found.where("reason IS NOT NULL").drop("content", "content_hash", "crawl_method")
    errored = failed.withColumn("error", F.col("reason")).withColumn("crawl_time", crawl_time).drop("reason")
    rows = ok_error_union(ok, errored, skip_unreachable)
    day = date_extract(F.col("date_added"), F.col("crawl_time"), F.to_date(crawl_time))
    rows = staged(to_store_rows(rows.withColumn("date", day)), "rows")
    failed = narrow(outcome.where("reason IS NOT NULL").drop("content", "content_hash", "crawl_method"))
    failures = failed.select(
        "pos", "url", F.col("name").alias("title"), "reason",
        F.date_format(crawl_time, "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
    )
    # Skipped: eligible bookmarks that were known or came twice.
    counts = run_summary(eligible, rows.where("error IS NULL"), outcome.limit(0), failures)
    attempted = outcome.agg(F.count(F.lit(1)).alias("n")).scalar()
    counts = counts.withColumn("skipped", F.col("valid") - attempted)
    return Ingested(rows, failures, counts, hashes.select("url_hash"))


def _nothing(eligible: DataFrame) -> Ingested:
    """A run in which every URL was known."""

    def empty(schema) -> DataFrame:
        return eligible.sparkSession.createDataFrame([], schema).where(F.lit(False))

    failures = empty(FAILURE)
    counts = run_summary(eligible, failures, failures, failures).withColumn("skipped", F.col("valid"))
    return Ingested(empty(STORE), failures, counts, empty("url_hash STRING"), nothing=True)


def at_store(spark: SparkSession, store_path: str, tried: Collection[str] = ()) -> dict:
    """Arguments of ``ingest`` that let a small batch open only segments of the store that can concern it.

    The URLs of segments named in ``tried`` are all among those seen, so they are not looked up here.
    """

    def lookup(hashes: DataFrame, column: str) -> DataFrame:
        return store_near(spark, store_path, hashes, column, without=tried if column == "url_hash" else ())

    return {"lookup": lookup, "last": last_key(spark, store_path)}


def ingest_into(
    bookmarks: DataFrame, pages: DataFrame, store_path: str, failures_path: str, segment: str, crawl_time: Column, remember: bool = False, **options
) -> Ingested:
    """Run an ingest and add its rows to a store, its failures to their table. Both go by the segment's name, so a run that starts again records nothing twice.

    With ``remember`` URLs that were tried before are not tried again, also where no row of theirs was stored.
    """
    spark, memory = bookmarks.sparkSession, f"{store_path}/seen"
    seen = seen_scan(spark, memory, without=segment) if remember else None
    done = ingest(bookmarks, pages, None, crawl_time, seen=seen, **at_store(spark, store_path), **options)
    failed_append(done.failures, failures_path, segment)
    if remember:
        seen_append(done.tried, memory, segment)
    store_append(done.rows, store_path, segment)
    return done
