"""Finding the charset of text that was decoded as Latin-1.

For each charset a table of byte pairs is fitted on texts as they should be: how likely one byte follows another when such a text is
written in that charset. Bytes of unknown charset are scored by each table, pairs with a byte beyond ASCII only, and must decode. The best charset wins; its
margin over the next one, per pair and cut at 1, is the confidence.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from pageloom.functions.encoding import encoding_suspect

#: A text in its own charset: nothing to repair.
OWN = "latin-1"
#: Charsets that are told apart unless others are named.
CHARSETS = (OWN, "utf-8", "cp1251", "koi8-r", "cp1250", "cp850", "mac-roman", "gb18030", "shift-jis", "euc-kr")
#: Texts the tables are fitted on, at most, and bytes of a text that is scored; a sample of pairs decides as well as all.
FIT_ROWS, SCORED_BYTES = 20_000, 1 << 16
#: Confidence from which a text is repaired.
CONFIDENT = 0.05
_PAIRS = 1 << 16


def _pairs(data: bytes) -> np.ndarray:
    """Pairs of neighbouring bytes of which one is beyond ASCII, as numbers."""
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.int64)
    both = codes[:-1] << 8 | codes[1:]
    return both[(codes[:-1] | codes[1:]) > 127]


@dataclass(frozen=True)
class CharsetModel:
    """A log-probability of each byte pair per charset."""

    charsets: tuple[str, ...]
    tables: np.ndarray

    def find(self, raw: bytes) -> tuple[str, float]:
        """(charset, confidence) of bytes; those that are all ASCII are in their own charset for certain."""
        # A cut may fall inside a character: the end is left to an incremental decoder.
        pairs = _pairs(raw[:SCORED_BYTES])
        if not len(pairs):
            return OWN, 1.0
        scores = self.tables[:, pairs].mean(axis=1)
        found = []
        for k, charset in enumerate(self.charsets):
            if _decodes(raw[:SCORED_BYTES], charset):
                found.append((float(scores[k]), charset))
        if not found:
            return OWN, 0.0
        found.sort(key=lambda x: (-x[0], x[1] != OWN, x[1]))
        return found[0][1], min(1.0, found[0][0] - found[1][0]) if len(found) > 1 else 1.0


def _decodes(raw: bytes, charset: str) -> bool:
    import codecs

    try:
        codecs.getincrementaldecoder(charset)("strict").decode(raw)
    except UnicodeDecodeError:
        return False
    return True


def fit_charsets(texts: DataFrame, column: str = "text", charsets: tuple[str, ...] = CHARSETS, rows: int = FIT_ROWS) -> CharsetModel:
    """Fit the tables on at most ``rows`` texts with letters beyond ASCII, those of the least hash.

    A text counts for the charsets that can write it. Pairs are counted in the tasks and added up; a table of 65,536 numbers per charset comes back.
    """
    keyed = texts.where(F.col(column).rlike(r"[^\x00-\x7F]")).select(F.xxhash64(column).alias("key"), F.col(column).alias("text"))
    chosen = keyed.select("key").distinct().orderBy("key").limit(rows)
    sample = keyed.join(F.broadcast(chosen), "key").groupBy("key").agg(F.min("text").alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals = np.zeros((len(charsets), _PAIRS), dtype=np.int64)
        for batch in batches:
            for text in batch["text"]:
                for k, charset in enumerate(charsets):
                    try:
                        totals[k] += np.bincount(_pairs(text.encode(charset)), minlength=_PAIRS)
                    except UnicodeEncodeError:
                        continue
        at = np.nonzero(totals)
        yield pd.DataFrame({"charset": at[0], "pair": at[1], "n": totals[at]})

    counted = sample.select("text").mapInPandas(count, "charset int, pair int, n long").groupBy("charset", "pair").agg(F.sum("n").alias("n"))
    tables = np.full((len(charsets), _PAIRS), 0.05)
    for r in counted.collect():
        tables[r["charset"], r["pair"]] += r["n"]
    return CharsetModel(tuple(charsets), np.log(tables / tables.sum(axis=1, keepdims=True)).astype(np.float32))


def charset_find(text: Column, model: CharsetModel, df: DataFrame) -> Column:
    """struct(charset, confidence) of texts that look wrongly decoded; NULL for all others."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("charset string, confidence double")
    def find(texts: pd.Series) -> pd.DataFrame:
        found = [(None, None) if t is None else shared.value.find(t.encode("latin-1", "ignore")) for t in texts]
        return pd.DataFrame(found, columns=["charset", "confidence"])

    suspect = encoding_suspect(text)
    return F.when(suspect, find(F.when(suspect, text)))


def encoding_repair_any(text: Column, model: CharsetModel, df: DataFrame, confident: float = CONFIDENT) -> Column:
    """Texts that look wrongly decoded, decoded by the charset that is found for each, if it is found with confidence; all others as they are."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("string")
    def repair(texts: pd.Series) -> pd.Series:
        def one(t):
            if t is None:
                return None
            raw = t.encode("latin-1", "ignore")
            charset, confidence = shared.value.find(raw)
            return t if charset == OWN or confidence < confident else raw.decode(charset, "replace")

        return texts.map(one)

    suspect = encoding_suspect(text)
    return F.when(suspect, repair(F.when(suspect, text))).otherwise(text)
