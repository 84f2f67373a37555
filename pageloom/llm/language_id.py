"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

N-grams of one to three lower-cased characters are hashed into ``DIMENSIONS`` places. Document frequencies are counted over all learnable
documents. The regression is trained by follow-the-regularised-leader with elastic-net penalties, on at most ``max_per_label`` documents
per language (those with the smallest id hashes); its temperature is calibrated on sampled documents it has not seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pageloom.llm.common import id_fold

DIMENSIONS = 1 << 15
MAX_PER_LABEL = 1500
#: Texts that the fitting task gets in all.
MAX_ROWS = 24_000
FOLDS, HELD_OUT = 3, 1
UNKNOWN = "und"
_CHUNK = 1 << 20
_MULTIPLY = tuple(np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def gram_counts(text: str) -> np.ndarray:
    """How often each hashed n-gram occurs. Long texts are counted in pieces that overlap by two characters."""
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    counts = np.zeros(DIMENSIONS, dtype=np.int64)
    shift = np.uint64(64 - DIMENSIONS.bit_length() + 1)
    for at in range(0, len(codes), _CHUNK):
        hashed = codes[at : at + _CHUNK + 2] * _MULTIPLY[0] + np.uint64(1)
        fresh = min(_CHUNK, len(codes) - at)
        counts += np.bincount((hashed[:fresh] >> shift).astype(np.int64), minlength=DIMENSIONS)
        base = codes[at : at + _CHUNK + 2]
        for n in (1, 2):
            hashed = (hashed[:-1] ^ (hashed[:-1] >> np.uint64(29))) * _MULTIPLY[n] + base[n:]
            mixed = (hashed ^ (hashed >> np.uint64(31))) * _MULTIPLY[0]
            counts += np.bincount((mixed[:fresh] >> shift).astype(np.int64), minlength=DIMENSIONS)
    return counts


def vector(text: str, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of the TF-IDF vector of length 1; term frequencies are damped by the logarithm."""
    counts = gram_counts(text)
    places = np.flatnonzero(counts)
    values = (1.0 + np.log(counts[places])) * idf[places]
    length = float(np.sqrt(values @ values))
    return places, values / length if length else values


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    weights: np.ndarray  # places x languages
    bias: np.ndarray
    idf: np.ndarray
    temperature: float

    def probabilities(self, places: np.ndarray, values: np.ndarray) -> np.ndarray:
        z = (values @ self.weights[places] + self.bias) / self.temperature
        e = np.exp(z - z.max())
        return e / e.sum()

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        p = self.probabilities(*vector(text, self.idf))
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def _leader(z: np.ndarray, n: np.ndarray, alpha: float, beta: float, l1: float, l2: float) -> np.ndarray:
    """The weights that follow the regularised leader; exactly 0 where |z| stays within the L1 penalty."""
    return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))


def train(rows: list[tuple[np.ndarray, np.ndarray]], labels: list[str], idf: np.ndarray, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.01, seed: int = 7) -> LanguageModel:
    """Fit on vectors and their languages; every fifth row of a language is kept back for the temperature."""
    languages = tuple(sorted(set(labels)))
    k = len(languages)
    if not k:
        return LanguageModel((), np.zeros((DIMENSIONS, 0)), np.zeros(0), idf, 1.0)
    target = np.array([languages.index(x) for x in labels])
    place = np.empty(len(labels), dtype=int)
    for c in range(k):
        place[target == c] = np.arange((target == c).sum())
    back = place % 5 == 4
    z, n = np.zeros((DIMENSIONS, k)), np.zeros((DIMENSIONS, k))
    z0, n0 = np.zeros(k), np.zeros(k)
    order = np.flatnonzero(~back)
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        for i in order:
            at, x = rows[i]
            w, b = _leader(z[at], n[at], alpha, beta, l1, l2), _leader(z0, n0, alpha, beta, 0.0, l2)
            scores = x @ w + b
            p = np.exp(scores - scores.max())
            p /= p.sum()
            p[target[i]] -= 1.0
            g = x[:, None] * p
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / alpha * w
            n[at] = grown
            grown0 = n0 + p * p
            z0 += p - (np.sqrt(grown0) - np.sqrt(n0)) / alpha * b
            n0 = grown0
    model = LanguageModel(languages, _leader(z, n, alpha, beta, l1, l2).astype(np.float32), _leader(z0, n0, alpha, beta, 0.0, l2), idf, 1.0)
    judged = np.flatnonzero(back) if back.any() else order
    logits = np.array([rows[i][1] @ model.weights[rows[i][0]] + model.bias for i in judged])
    return LanguageModel(languages, model.weights, model.bias, idf, _temperature(logits, target[judged]))


def _temperature(logits: np.ndarray, target: np.ndarray) -> float:
    """The temperature of the least log loss, by golden section over its logarithm."""

    def loss(log_t: float) -> float:
        z = logits / np.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), target]).mean())

    low, high, ratio = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def document_frequencies(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many texts of ``docs(text)`` each n-gram occurs, and how many texts there are; each task sends ``DIMENSIONS`` numbers at most."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
        for batch in batches:
            for text in batch["text"]:
                seen += gram_counts(text) > 0
                rows += 1
        if rows:
            at = np.flatnonzero(seen)
            yield pd.DataFrame({"place": np.append(at, -1).astype("int32"), "docs": np.append(seen[at], rows)})

    got = docs.select("text").mapInPandas(count, "place int, docs long").groupBy("place").agg(F.sum("docs").alias("docs")).collect()
    frequency, rows = np.zeros(DIMENSIONS, dtype=np.int64), 0
    for place, n in got:
        if place < 0:
            rows = n
        else:
            frequency[place] = n
    return frequency, rows


def fit_languages(docs: DataFrame, max_per_label: int = MAX_PER_LABEL, held_out: bool = True, max_rows: int = MAX_ROWS) -> LanguageModel:
    """Fit on the rows of ``docs(doc_id, text, lang)`` that have a text with a letter and a lang, the held-out fold left out.

    Whole texts, and document frequencies of all such rows. The sample is a broadcast of at most ``max_per_label`` ids per language and ``max_rows`` in all; of
    several texts with one id and language the least counts. Without any such row the model knows no language.
    """
    usable = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}"))
    if held_out:
        usable = usable.where(id_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    frequency, total = document_frequencies(usable)
    idf = np.log((1.0 + total) / (1.0 + frequency)) + 1.0
    # The task that fits gets at most ``max_rows`` texts, or one per language where there are more of these.
    per_label = min(max_per_label, max(1, max_rows // max(1, usable.select("lang").distinct().count())))
    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    sample = usable.select("doc_id", "lang").withColumn("nth", nth).where(F.col("nth") <= per_label).select("doc_id", "lang").distinct()

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [vector(t, idf) for t in batch["text"]]
            yield pd.DataFrame({"doc_id": batch["doc_id"], "lang": batch["lang"], "places": [p.astype(np.int32) for p, _ in found], "values": [v.astype(np.float32) for _, v in found]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["doc_id", "lang", "places", "values"])], ignore_index=True)
        rows = rows.sort_values(["doc_id", "lang"], kind="stable", ignore_index=True)
        data = [(np.asarray(p, dtype=np.int64), np.asarray(v, dtype=np.float64)) for p, v in zip(rows["places"], rows["values"])]
        model = train(data, rows["lang"].tolist(), idf)
        yield pd.DataFrame({"languages": [list(model.languages)], "weights": [model.weights.astype(np.float32).tobytes()], "bias": [model.bias.tolist()], "temperature": [model.temperature]})

    chosen = docs.select("doc_id", "text", "lang").where("text IS NOT NULL").join(F.broadcast(sample), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    placed = chosen.mapInPandas(vectors, "doc_id long, lang string, places array<int>, values array<float>")
    got = placed.repartition(1).mapInPandas(fit, "languages array<string>, weights binary, bias array<double>, temperature double").first()
    if got is None:
        return train([], [], idf)
    weights = np.frombuffer(got["weights"], dtype=np.float32).reshape(DIMENSIONS, len(got["languages"]))
    return LanguageModel(tuple(got["languages"]), weights, np.array(got["bias"]), idf, got["temperature"])


def identify_languages(docs: DataFrame, max_per_label: int = MAX_PER_LABEL) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of ``docs(doc_id, text, lang)``, predicted from its whole text alone.

    Texts that are NULL or hold no letter are ``und`` with score 0, and all are when no language could be learned. Rows that repeat are
    predicted each; a NULL id like any other. Other columns are ignored. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(fit_languages(docs, max_per_label))

    @F.pandas_udf("struct<lang_pred:string,score:double>")
    def of(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([shared.value.predict(t) for t in texts], columns=["lang_pred", "score"])

    held = (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out")
    return docs.select("doc_id", held, of(F.col("text")).alias("p")).select("doc_id", "held_out", "p.lang_pred", "p.score")
