"""Substring de-duplication by hashes of lines or paragraphs.

A unit is a line (or a paragraph); a line that runs on is cut after each sentence, so that a
passage pasted into the middle of a line still meets itself elsewhere. Units are
normalised, hashed to 128 bits and grouped over the whole corpus: the occurrence of the smallest (doc_id, unit number)
stays, all others are removed. Offsets are those of the original text.

With the unit ``piece`` no word is left out: sentences are cut further at words that the words around them decide, so that both sides
of a passage are cut alike, whatever stands before it. A short sentence counts together with the piece beside it; a
line alone is a unit however short. In scripts without blanks every sign is a word.
"""

from __future__ import annotations

import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.operators.sizing import small_side
from pageloom.session import staged

#: What ends a unit.
ENDS = {
    "line": re.compile(r"\n"),
    "sentence": re.compile(r"[.!?]+(?=\s)|\n"),
    "paragraph": re.compile(r"\n[ \t]*\n"),
}
#: Units that a task compares with each other and sends to Arrow at once.
BATCH_UNITS = 500_000
#: Scripts without blanks between words: Thai, Lao, Myanmar, Khmer, kana, Han.
_UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3000-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff01-\uff65\U00020000-\U0003ffff"
_MARKS = "".join(c for c in map(chr, (*range(0x0E00, 0x1100), *range(0x1780, 0x1800), 0x3099, 0x309A)) if unicodedata.category(c)[0] == "M")
#: A word, or a sign of such a script with its marks.
TOKEN = re.compile(rf"[{_UNSPACED}][{_MARKS}]*|[^\s{_UNSPACED}]+")
#: What ends a sentence, and what may follow it.
STOPS, CLOSERS = ".!?\u2026\u3002\uff01\uff1f\uff61\u0964\u0965\u061f\u06d4\u1362\u104b\u17d4", "\"')]}\u201d\u2019\u00bb\u203a\u300d\u300f\uff09"
_LAST = frozenset(STOPS + CLOSERS)
#: Words whose hashes are kept at most.
CACHED_WORDS = 1_000_000


def _ends_sentence(token: str) -> bool:
    inner = token.rstrip(CLOSERS)
    return inner != "" and inner[-1] in STOPS


def pieces(text: str, min_words: int, cache: dict[str, int]) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, words that count) of the pieces of a text; every word lies in one.

    A sentence is cut before each word whose hash is less than those of the ``min_words - 1`` words before it and not more than those of as many after
    it, if that many words are on either side of the cut. Sentences of fewer than ``min_words`` words count with the piece beside them.
    """
    import xxhash

    found = list(TOKEN.finditer(text))
    n = len(found)
    if not n:
        return
    tokens = [m.group() for m in found]
    starts = np.fromiter((m.start() for m in found), dtype=np.int64, count=n)
    stops = np.fromiter((m.end() for m in found), dtype=np.int64, count=n)
    del found
    hashes = np.empty(n, dtype=np.uint64)
    for k, token in enumerate(tokens):
        h = cache.get(token)
        if h is None:
            if len(cache) >= CACHED_WORDS:
                cache.clear()
            h = cache[token] = xxhash.xxh64_intdigest(token.casefold().encode("utf-8", "surrogatepass"))
        hashes[k] = h
    # Where lines and sentences begin, by word.
    breaks = np.fromiter((m.start() for m in ENDS["line"].finditer(text)), dtype=np.int64)
    line = np.searchsorted(breaks, starts)
    new_line = np.ones(n, dtype=bool)
    new_line[1:] = line[1:] != line[:-1]
    ends = np.fromiter((t[-1] in _LAST and _ends_sentence(t) for t in tokens), dtype=bool, count=n)
    spaced = np.ones(n, dtype=bool)
    spaced[1:] = (starts[1:] > stops[:-1]) | np.fromiter((t[0] > "\u2fff" for t in tokens[:-1]), dtype=bool, count=n - 1)
    begins = new_line.copy()
    # A sentence ends with the last of several closing signs.
    begins[1:] |= ends[:-1] & spaced[1:] & ~np.fromiter((t[0] in _LAST and not t.strip(STOPS + CLOSERS) for t in tokens[1:]), dtype=bool, count=n - 1)
    first = np.flatnonzero(begins)
    sentence = np.cumsum(begins) - 1
    length = np.diff(np.append(first, n))
    place = np.arange(n) - first[sentence]
    least = (place >= min_words) & (length[sentence] - place >= min_words)
    at = np.flatnonzero(least)
    if len(at):
        # A word weighs with the one before it, so that no frequent word makes most cuts.
        with np.errstate(over="ignore"):
            weight = hashes * np.uint64(0x9E3779B97F4A7C15)
            weight[1:] += hashes[:-1] * np.uint64(0xC2B2AE3D27D4EB4F)
        low = np.ones(len(at), dtype=bool)
        for k in range(1, min_words):
            low &= (weight[at] < weight[at - k]) & (weight[at] <= weight[np.minimum(at + k, n - 1)])
        begins[at[low]] = True
    cuts = [*np.flatnonzero(begins).tolist(), n]
    for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
        words = tokens[a:b]
        if b - a < min_words:
            # One that counts with another is not equal to a whole unit of the same words, nor to that other.
            if not new_line[a]:
                words = [*tokens[cuts[k - 1] : b], "\n", "after", str(b - a)]
            elif b < n and not new_line[b]:
                words = [*tokens[a : cuts[k + 2]], "\n", "before", str(b - a)]
        yield int(starts[a]), int(stops[b - 1]), words


def cut(text: str, unit: str) -> Iterator[tuple[int, int, list[str]]]:
    """(start, stop, words) of the units of a text, white space around them left out; signs that end a sentence belong to it."""
    at = 0
    for end in (*(m.end() for m in ENDS[unit].finditer(text)), len(text)):
        raw = text[at:end]
        words = raw.split()
        if words:
            yield at + len(raw) - len(raw.lstrip()), end - len(raw) + len(raw.rstrip()), words
        at = end


def normalised(words: list[str]) -> str:
    """What makes two units equal: the text without case, its white space runs as one blank."""
    return " ".join(words).casefold()


_UNITS = pa.schema([("doc_id", pa.int64()), ("text_key", pa.int64()), ("start", pa.int32()), ("stop", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("again", pa.bool_())])


def _ranks(doc_id: pa.Array, start: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, ...]:
    """What orders occurrences: id (none of them last), place, hash of the text."""
    none = np.asarray(doc_id.is_null())
    return none, doc_id.fill_null(0).to_numpy(zero_copy_only=False), start, key


def later_ones(h1: np.ndarray, h2: np.ndarray, ranks: tuple[np.ndarray, ...], before: tuple | None = None) -> tuple[np.ndarray, tuple]:
    """Which rows, in order of (digest, rank), come after the first of their digest, and (digest, rank) of the last digest's first.

    ``before`` is that of the rows that came earlier. Rows of one rank are one occurrence.
    """
    new = np.ones(len(h1), dtype=bool)
    new[1:] = (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])
    goes_on = before is not None and (h1[0], h2[0]) == before[:2]
    first = np.maximum.accumulate(np.where(new, np.arange(len(h1)), 0))
    later = np.zeros(len(h1), dtype=bool)
    for r in ranks:
        later |= r != r[first]
    if goes_on:
        mine = first == 0
        same = np.ones(len(h1), dtype=bool)
        for r, value in zip(ranks, before[2]):
            same &= r == value
        later = np.where(mine, ~same, later)
    k = first[-1]
    last = before if goes_on and k == 0 else (h1[k], h2[k], tuple(r[k] for r in ranks))
    return later, last


def unit_digests(docs: DataFrame, unit: str = "sentence", min_words: int = 5) -> DataFrame:
    """(doc_id, text_key, start, stop, h1, h2, again) of the units of ``docs`` with at least ``min_words`` words, of all pieces.

    ``start`` and ``stop`` count code points of the original text and leave out white space around the unit. ``again`` marks units that stand earlier among
    those that the task had at hand: of a digest a task leaves one unmarked for each ``BATCH_UNITS``, however often it occurs.
    """

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows))
        doc_id = pa.array(columns[0], pa.int64())
        key, start, stop, h1, h2 = (np.array(c, dtype=t) for c, t in zip(columns[1:], ("i8", "i4", "i4", "i8", "i8")))
        ranks = _ranks(doc_id, start, key)
        order = np.lexsort((*reversed(ranks), h2, h1))
        again = np.empty(len(rows), dtype=bool)
        again[order], _ = later_ones(h1[order], h2[order], tuple(r[order] for r in ranks))
        return pa.RecordBatch.from_arrays([doc_id, pa.array(key), pa.array(start), pa.array(stop), pa.array(h1), pa.array(h2), pa.array(again)], schema=_UNITS)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        rows: list[tuple] = []
        cache: dict[str, int] = {}
        for batch in batches:
            for doc_id, key, text in zip(*(batch.column(k).to_pylist() for k in range(3))):
                for start, stop, words in pieces(text, min_words, cache) if unit == "piece" else cut(text, unit):
                    if unit == "piece" or len(words) >= min_words:
                        rows.append((doc_id, key, start, stop, *struct.unpack(">qq", xxhash.xxh3_128_digest(normalised(words).encode("utf-8", "surrogatepass")))))
                        if len(rows) >= BATCH_UNITS:
                            yield batch_of(rows)
                            rows = []
        if rows:
            yield batch_of(rows)

    named = docs.where("text IS NOT NULL AND text <> ''").select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("text_key"), "text")
    return named.mapInArrow(digest, "doc_id long, text_key long, start int, stop int, h1 long, h2 long, again boolean")


def later_units(units: DataFrame) -> DataFrame:
    """(doc_id, text_key, start, stop) of the units that are not the earliest of their digest.

    Those a task has marked are not moved. The others meet by digest in one shuffle, in order, and stream past; a task compares each with the first of
    its digest and holds one batch.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before = None
        for batch in batches:
            if batch.num_rows:
                doc_id = batch.column("doc_id")
                start, key, h1, h2 = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("start", "text_key", "h1", "h2"))
                later, before = later_ones(h1, h2, _ranks(doc_id, start, key), before)
                yield batch.select(["doc_id", "text_key", "start", "stop"]).filter(pa.array(later))

    order = ["h1", "h2", F.col("doc_id").asc_nulls_last(), "start", "text_key"]
    open_units = units.where("NOT again").select("doc_id", "text_key", "start", "stop", "h1", "h2").repartition("h1", "h2").sortWithinPartitions(*order)
    met = open_units.mapInArrow(compare, "doc_id long, text_key long, start int, stop int")
    return units.where("again").select("doc_id", "text_key", "start", "stop").unionByName(met)


def _spans(units: DataFrame, name: str) -> DataFrame:
    grouped = units.groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias(name))
    return grouped.withColumnsRenamed({"doc_id": f"{name}_doc", "text_key": f"{name}_key"})


def _of(rows: DataFrame, spans: DataFrame, name: str) -> DataFrame:
    """``rows(doc_id, text, ...)`` with the spans of their (doc_id, text), an empty array without any."""
    same = rows["doc_id"].eqNullSafe(spans[f"{name}_doc"]) & (F.xxhash64(rows["text"]) == spans[f"{name}_key"])
    none = F.array().cast("array<struct<start:int,stop:int>>")
    return rows.join(spans, same, "left").select(*rows.columns, F.coalesce(name, none).alias(name))


def dedup_units(docs: DataFrame, unit: str = "sentence", min_words: int = 5) -> DataFrame:
    """Each row of ``docs(doc_id, text)`` with ``removed`` (array of start, stop) and ``kept_text``.

    The earliest occurrence is the one of the smallest (doc_id, start), a NULL doc_id last, ties by the text's hash. Of rows equal in doc_id and text (NULL
    ids are equal) one is the first and the others come after it: they lose every unit. NULL stays NULL, an empty text stays empty, a text without
    repeats is unchanged with an empty ``removed``. Units of fewer than ``min_words`` words always stay, but for the unit ``piece``, which leaves none out. Of
    the columns of ``docs`` only doc_id and text are returned.
    """
    # Cut once: the table serves the comparison, and the rows that repeat.
    units = staged(unit_digests(docs, unit, min_words), "units")
    named = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # Rows that repeat, told by id and hash; their texts meet before the shuffle.
    counted = named.where("text <> ''").groupBy("doc_id", F.xxhash64("text").alias("text_key")).agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = staged(counted.select(F.col("doc_id").alias("r_doc"), F.col("text_key").alias("r_key"), "n"), "repeated-rows")
    spans = _spans(later_units(units), "removed")
    if repeated.take(1):
        same = F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.xxhash64("text") == F.col("r_key"))
        first = named.join(small_side(repeated), same).groupBy("doc_id", "text", "n").agg(F.lit(1).alias("one"))
        whole = units.join(small_side(repeated), F.col("doc_id").eqNullSafe(F.col("r_doc")) & (F.col("text_key") == F.col("r_key")), "left_semi")
        copies = first.select("doc_id", "text", F.explode(F.expr("sequence(2L, n)")).alias("k")).drop("k")
        others = named.join(small_side(repeated), same, "left_anti")
        rows = _of(others.unionByName(first.select("doc_id", "text")), spans, "removed")
        again = _of(copies, _spans(whole, "all_units"), "all_units").withColumnRenamed("all_units", "removed")
        rows = rows.unionByName(again)
    else:
        rows = _of(named, spans, "removed")
    some = F.size("removed") > 0
    kept = _without(F.when(some, F.col("text")), F.col("removed.start"), F.col("removed.stop"))
    return rows.withColumn("kept_text", F.when(some, kept).otherwise(F.col("text")))


def _without(text: Column, starts: Column, stops: Column) -> Column:
    """What stands between the end of one span and the start of the next one; NULL texts are passed over."""

    @F.pandas_udf("string")
    def cut_out(texts: pd.Series, starts: pd.Series, stops: pd.Series) -> pd.Series:
        # A text of many spans is gone through once; the substring function would count its signs from the start for each.
        return pd.Series([None if t is None else "".join(t[a:b] for a, b in zip([0, *z], [*x, len(t)])) for t, x, z in zip(texts, starts, stops)], dtype=object)

    return cut_out(text, starts, stops)
