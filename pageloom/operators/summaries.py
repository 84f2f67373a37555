"""Summaries by a function the caller brings."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.text import cut, is_blank
from pageloom.operators.joins import existing_summary_join
from pageloom.schema import SUMMARY_FAILED

PROMPT = """Summarise the web page below in its own language. Keep names, numbers, dates and \
technical terms, group the facts by topic, and write nothing but the summary.

Title: {title}
Address: {url}

{content}
"""


def _needs(force: bool) -> Column:
    fetched = F.col("content").isNotNull() & F.col("error").isNull()
    return fetched if force else fetched & is_blank(F.col("stored_summary"))


def summary_backlog(store: DataFrame, force: bool = False, bookmarks: DataFrame | None = None) -> DataFrame:
    """Rows that need a summary: fetched without error and, unless forced, without a stored one.

    Without ``bookmarks`` the store is its own input and its summary column is
    the stored summary, which saves the join.
    """
    if bookmarks is None:
        joined = store.withColumn("stored_summary", F.col("summary"))
    else:
        joined = existing_summary_join(bookmarks, store)
    return joined.where(_needs(force)).drop("stored_summary")


def summary_run_counts(df: DataFrame, force: bool = False) -> DataFrame:
    """Success, skipped and total of a run over rows with ``stored_summary`` and the new ``summary``.

    A row with a stored summary counts both as success and as skipped.
    """
    fetched = F.col("content").isNotNull() & F.col("error").isNull()
    has = ~is_blank(F.col("stored_summary"))
    kept = F.lit(False) if force else fetched & has
    made = fetched & ~kept & F.col("summary").isNotNull() & (F.instr("summary", SUMMARY_FAILED) == 0)
    return df.agg(
        F.count_if(kept | made).alias("success"),
        F.count_if(~fetched | kept).alias("skipped"),
        F.count(F.lit(1)).alias("total"),
    )


def prompt_build(df: DataFrame, template: str = PROMPT, max_chars: int | None = None) -> DataFrame:
    """Add ``prompt``: the template with title, url and content filled in.

    Contents stay whole; a caller whose model takes less names its limit as ``max_chars``.

    The template is cut at its placeholders, so braces in a page stay text.
    """
    values = {
        "title": F.coalesce(F.col("title"), F.col("name"), F.lit("No Title")),
        "url": F.col("url"),
        "content": cut(F.col("content"), max_chars),
    }
    parts: list[Column] = []
    rest = template
    while rest:
        found = [(rest.find("{" + name + "}"), name) for name in values]
        at, name = min(((a, n) for a, n in found if a >= 0), default=(-1, ""))
        if at < 0:
            parts.append(F.lit(rest))
            break
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name], F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return df.withColumn("prompt", F.concat(*parts))


def _summariser(fn: Callable[[pd.Series], pd.Series]):
    def attempt(prompts: pd.Series) -> pd.Series:
        try:
            return pd.Series(list(fn(prompts)), index=prompts.index, dtype=object)
        except Exception as error:
            if len(prompts) == 1:
                return pd.Series([f"{SUMMARY_FAILED}: {error}"], index=prompts.index, dtype=object)
            # One prompt must not spoil its batch.
            return pd.concat([attempt(prompts.iloc[i : i + 1]) for i in range(len(prompts))])

    def summarise(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for prompts in batches:
            yield attempt(prompts) if len(prompts) else prompts

    summarise.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    # A model may answer differently when asked again, so Spark must not repeat or move the call.
    return F.pandas_udf(summarise, "string").asNondeterministic()


def summary_apply(
    df: DataFrame, fn: Callable[[pd.Series], pd.Series], model: str, summary_time: Column | None = None
) -> DataFrame:
    """Set ``summary``, ``summary_model`` and ``summary_time`` by calling ``fn`` on batches of prompts.

    Only the prompt travels to Python. A prompt on which ``fn`` raises gets the
    failure text; ``stored_summaries`` leaves such rows out.
    """
    return df.withColumn("summary", _summariser(fn)(F.col("prompt"))).withColumns(
        {"summary_model": F.lit(model), "summary_time": F.current_timestamp() if summary_time is None else summary_time}
    ).drop("prompt")


def stored_summaries(applied: DataFrame) -> DataFrame:
    """The rows whose summary is fit to be stored."""
    return applied.where(F.instr("summary", SUMMARY_FAILED) == 0)
