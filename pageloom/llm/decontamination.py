"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are the windows of ``WINDOW`` consecutive words of each item; an item with fewer words is one shorter
pattern. Patterns of one length m share a shift table: for each block of two words, how far the text can be
moved on before a pattern could end with it, m - 1 for blocks that no pattern has. At shift 0 the block's bucket holds the patterns that end with it, and
comparison with the whole window decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.session import staged

WINDOW = 10
#: Item text that one matcher holds at most; larger sets of items are searched in several passes.
CHUNK_BYTES = 16 << 20
#: Bytes of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]`` once A-Z are lower-cased: digits, a-z, and all of a character beyond ASCII.
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Finds the windows of ``items`` (id, text) in texts."""

    def __init__(self, items: Iterable[tuple[str, str | None]], window: int = WINDOW):
        self.ids: dict[bytes, int] = {}
        owners: dict[int, dict[tuple[int, ...], set[str]]] = defaultdict(lambda: defaultdict(set))
        for item, text in items:
            known = [self.ids.setdefault(w, len(self.ids) + 1) for w in item_words(text)]
            if known:
                m = min(window, len(known))
                for k in range(len(known) - m + 1):
                    owners[m][tuple(known[k : k + m])].add(item)
        self.stride = len(self.ids) + 1
        #: By pattern length: shifts by block, and by block the patterns that end with it with their items.
        self.tables = []
        for m, patterns in sorted(owners.items()):
            shift: dict[int, int] = {}
            buckets: dict[int, dict[tuple[int, ...], frozenset[str]]] = defaultdict(dict)
            for pattern, items_of in patterns.items():
                if m > 1:
                    for k in range(1, m):
                        block = pattern[k - 1] * self.stride + pattern[k]
                        shift[block] = min(shift.get(block, m - 1), m - 1 - k)
                    block = pattern[-2] * self.stride + pattern[-1]
                else:
                    block = pattern[0]
                    shift[block] = 0
                buckets[block][pattern] = frozenset(items_of)
            self.tables.append((m, shift, dict(buckets)))

    def search(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """The spans of words inside any occurrence, apart and in order, and the items whose windows occur."""
        get = self.ids.get
        text = [get(w, 0) for w in words]
        ends: list[tuple[int, int]] = []
        found: set[str] = set()
        n, stride = len(text), self.stride
        for m, shift, buckets in self.tables:
            if m == 1:
                for at, word in enumerate(text):
                    if word in shift:
                        ends.append((at, at + 1))
                        found |= buckets[word][(word,)]
                continue
            step, at, shift_of = m - 1, m - 1, shift.get
            while at < n:
                last = text[at]
                move = shift_of(text[at - 1] * stride + last, step) if last else step
                if move:
                    at += move if last else m
                    continue
                window = tuple(text[at - m + 1 : at + 1])
                items = buckets[text[at - 1] * stride + last].get(window)
                if items is not None:
                    ends.append((at - m + 1, at + 1))
                    found |= items
                at += 1
        spans: list[tuple[int, int]] = []
        for a, b in sorted(ends):
            if spans and a <= spans[-1][1]:
                spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
            else:
                spans.append((a, b))
        return spans, found


def matchers(benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> Iterator[WuManber]:
    """A matcher for each part of ``benchmark(item_id, text)``; a part has at most ``chunk_bytes`` of text, or one item."""
    sized = benchmark.where("text IS NOT NULL").select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text")
    total = sized.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = -(-2 * total // chunk_bytes) if total > chunk_bytes else 1
    for part in range(parts):
        mine = sized if parts == 1 else sized.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part)
        yield WuManber([tuple(r) for r in mine.toLocalIterator()], window)


HITS = "struct<n_words:long,spans:array<struct<start:int,stop:int>>,items:array<string>>"


def hits(text: Column, matcher) -> Column:
    """What a broadcast ``matcher`` finds in a text: ``n_words``, ``spans`` of words, ``items``."""

    @F.pandas_udf(HITS)
    def of(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            words = item_words(t)
            spans, items = matcher.value.search(words)
            rows.append((len(words), [{"start": a, "stop": b} for a, b in spans], sorted(items)))
        return pd.DataFrame(rows, columns=["n_words", "spans", "items"])

    return of(text)


def _merged(spans: Column) -> Column:
    """How many words sorted, perhaps overlapping spans cover."""
    start = F.struct(F.lit(0).alias("upto"), F.lit(0).cast("long").alias("n"))
    return F.aggregate(
        spans,
        start,
        lambda s, x: F.struct(F.greatest(s["upto"], x["stop"]).alias("upto"), (s["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(s["upto"], x["start"]))).alias("n")),
        lambda s: s["n"],
    )


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, spans, items) for each row of ``docs(doc_id, text)``.

    Words are runs of digits, letters a-z (A-Z lower-cased) and characters beyond ASCII, of the whole text; NULL and empty texts have
    none. ``spans`` are the word ranges inside occurrences, ``items`` the distinct item_ids (as strings, sorted) with
    an occurring window. Items without words, and an empty benchmark, hit nothing; repeated items count once,
    a NULL item_id is the empty one. Each row has its own result, repeated ids
    too; other columns are ignored.
    """
    spark = docs.sparkSession
    parts = []
    for matcher in matchers(benchmark, window, chunk_bytes):
        shared = spark.sparkContext.broadcast(matcher)
        found = docs.select("doc_id", F.xxhash64("text").alias("text_key"), hits(F.col("text"), shared).alias("h"))
        parts.append(found.select("doc_id", "text_key", F.col("h.n_words").alias("n_words"), F.col("h.spans").alias("spans"), F.col("h.items").alias("items")))
    first = parts[0]
    if len(parts) > 1:
        # Every pass sees all rows; those with hits in later passes are few and meet the rows of the first by id and text.
        first = staged(first, "hits")
        later = [staged(p.where("size(items) > 0").distinct(), "hits") for p in parts[1:]]
        more = later[0]
        for p in later[1:]:
            more = more.union(p)
        more = more.groupBy(F.col("doc_id").alias("d"), F.col("text_key").alias("k")).agg(F.flatten(F.collect_list("spans")).alias("s"), F.flatten(F.collect_list("items")).alias("t"))
        joined = first.join(more, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")), "left")
        spans = F.when(F.col("s").isNull(), F.col("spans")).otherwise(F.array_sort(F.concat("spans", "s")))
        items = F.when(F.col("t").isNull(), F.col("items")).otherwise(F.array_sort(F.array_distinct(F.concat("items", "t"))))
        first = joined.select("doc_id", "n_words", spans.alias("spans"), items.alias("items"))
    return first.select("doc_id", "n_words", _merged(F.col("spans")).alias("n_hit"), "spans", "items")
