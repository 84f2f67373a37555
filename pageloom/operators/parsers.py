"""Parsers that look at every bookmark before its page is taken."""

from __future__ import annotations

import logging
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from pageloom.functions.html import article_extract
from pageloom.functions.urls import site_route, suspended_url_rewrite, RENDERED
from pageloom.operators.joins import video_metadata_join

log = logging.getLogger(__name__)

Parser = Callable[[DataFrame], DataFrame]


def parser_chain(df: DataFrame, registry: dict[str, Parser], enabled: list[str] | None = None) -> DataFrame:
    """Run the parsers in the order of their names.

    ``enabled`` picks some of them; an unknown name is a warning. A parser that
    raises while it is planned, or returns nothing, is passed over.
    """
    for name in enabled or []:
        if name not in registry:
            log.warning("parser %s is not known", name)
    for name in sorted(registry):
        if enabled is not None and name not in enabled:
            continue
        try:
            parsed = registry[name](df)
        except Exception as error:
            log.warning("parser %s left out: %s", name, error)
            continue
        if isinstance(parsed, DataFrame):
            df = parsed
    return df


def row_parser(fn: Callable[[dict], dict | None], adds: str = "") -> Parser:
    """Turn a function of one bookmark into a parser.

    Rows on which it raises, gives no dict or gives a value that does not fit its column stay as they are. The result has
    the columns of the input, and those that ``adds`` names (as in ``description string``).
    """

    def parse(df: DataFrame) -> DataFrame:
        more = [f for f in (T.StructType.fromDDL(adds).fields if adds else []) if f.name not in df.columns]
        df = df.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
        columns = df.columns

        def one(row: dict) -> dict:
            try:
                result = fn(dict(row))
            except Exception:
                return row
            return result if isinstance(result, dict) and result else row

        def fits(row: dict, schema: pa.Schema) -> bool:
            try:
                pa.RecordBatch.from_pylist([row], schema)
            except (pa.ArrowException, TypeError, ValueError, OverflowError):
                return False
            return True

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                before = batch.to_pylist()
                rows = [{c: row.get(c) for c in columns} for row in map(one, before)]
                try:
                    yield pa.RecordBatch.from_pylist(rows, batch.schema)
                except (pa.ArrowException, TypeError, ValueError, OverflowError):
                    # Some value does not fit: find its row.
                    yield pa.RecordBatch.from_pylist([new if fits(new, batch.schema) else old for new, old in zip(rows, before)], batch.schema)

        return df.mapInArrow(run, df.schema)

    return parse


def suspended_tabs(df: DataFrame) -> DataFrame:
    """Parked tabs get the address they stand for."""
    return df.withColumn("url", suspended_url_rewrite(F.col("url")))


def rendered_article(df: DataFrame) -> DataFrame:
    """Bookmarks of rendered sites that carry ``html`` get its article as ``content``."""
    article = article_extract(F.col("html"), selectors=(".Post-RichText", ".RichText"), strip_nodes=False)
    old = F.col("content") if "content" in df.columns else F.lit(None).cast("string")
    return df.withColumn(
        "content", F.when((site_route(F.col("url")) == RENDERED) & F.col("html").isNotNull(), article).otherwise(old)
    )


def video_details(meta: DataFrame, transcripts: DataFrame) -> Parser:
    """Video bookmarks get a description."""
    return lambda df: video_metadata_join(df, meta, transcripts)
