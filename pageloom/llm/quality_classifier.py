"""A quality classifier: naive Bayes support vectors.

Features are indicators of n-grams, hashed into ``DIMENSIONS`` places: words, the shapes of one to three neighbouring words, and runs of a
repeated word. An indicator is scaled by its class log-count ratio; a linear hinge-loss model on top is trained by dual coordinate descent;
its margins become probabilities through a logistic curve fitted on rows that the model has not seen.

The model is fitted on a bounded sample: at most ``max_rows`` labelled rows, those with the smallest id hashes. Scoring covers every text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import first_by_hash, id_fold

DIMENSIONS = 1 << 18
MAX_ROWS = 12_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7
#: Bytes by class: a lower-case letter (and all of a character beyond ASCII), a capital, a digit; signs stay.
_SHAPE = bytes(0x61 if 0x61 <= b <= 0x7A or b >= 0x80 else 0x41 if 0x41 <= b <= 0x5A else 0x30 if 0x30 <= b <= 0x39 else b for b in range(256))
_RUN = re.compile(rb"([^\s])\1+")


def features(text: str | None) -> np.ndarray:
    """The sorted places of a text's n-grams; none for NULL and for a text without words."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.lower().split()
    if not words:
        return np.empty(0, dtype=np.int32)
    shapes = _RUN.sub(rb"\1", raw.translate(_SHAPE)).split()
    grams: set[bytes] = set(words)
    for n in (1, 2, 3):
        grams.update(b"\x01" + b" ".join(g) for g in set(zip(*(shapes[k:] for k in range(n)))))
    same = bytes(a == b for a, b in zip(words, words[1:]))
    for n in (1, 2, 4, 8):
        if b"\x01" * n in same:
            grams.add(b"\x02%d" % n)
    crc = zlib.crc32
    return np.unique(np.fromiter((crc(g) & (DIMENSIONS - 1) for g in grams), dtype=np.int32, count=len(grams)))


@dataclass(frozen=True)
class NBSVM:
    """``weights`` already hold the log-count ratios; scores are 1 / (1 + exp(-(slope * margin + offset)))."""

    weights: np.ndarray
    bias: float
    slope: float
    offset: float

    def margin(self, places: np.ndarray) -> float:
        return float(self.weights[places].sum()) / max(1.0, len(places)) ** 0.5 + self.bias

    def score(self, text: str | None) -> float:
        z = self.slope * self.margin(features(text)) + self.offset
        return float(1 / (1 + np.exp(-np.clip(z, -60, 60))))


def _dual_descent(rows: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: np.ndarray, epochs: int, seed: int) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear support vector machine, one dual variable at a time."""
    w, bias = np.zeros(DIMENSIONS), 0.0
    scaled = [ratio[r] / max(1.0, len(r)) ** 0.5 for r in rows]
    norm = np.array([float(x @ x) + 1.0 for x in scaled])
    alpha = np.zeros(len(rows))
    order = np.arange(len(rows))
    random = np.random.default_rng(seed)
    for _ in range(epochs):
        random.shuffle(order)
        most = 0.0
        for i in order:
            x, r, y = scaled[i], rows[i], signs[i]
            gradient = y * (float(w[r] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * y
            if step:
                w[r] += step * x
                bias += step
                alpha[i] = new
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return w, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the labels' probability by margin, by Newton steps with smoothed labels."""
    good, bad = labels.sum(), (1 - labels).sum()
    goal = np.where(labels == 1, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = np.array([((p - goal) * margins).sum() + 1e-3 * (a - 1), (p - goal).sum()])
        v = p * (1 - p)
        h = np.array([[(v * margins * margins).sum() + 1e-3, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return float(max(a, 1e-3)), float(b)


def train(rows: list[np.ndarray], labels: np.ndarray, epochs: int = 30, cost: float = 1.0, smooth: float = 1.0, seed: int = 7) -> NBSVM:
    """Fit on feature places and 0/1 labels. Without rows of both labels the score is the share of label 1 (0.5 of nothing)."""
    good = int((labels == 1).sum())
    if good == 0 or good == len(labels):
        share = (good + 0.5) / (len(labels) + 1)
        return NBSVM(np.zeros(DIMENSIONS, dtype=np.float32), 0.0, 1.0, float(np.log(share / (1 - share))))
    # Every fifth row of either label is kept back for the probabilities, where there are enough.
    place = np.empty(len(labels), dtype=int)
    for label in (0, 1):
        place[labels == label] = np.arange((labels == label).sum())
    back = (place % 5 == 4) if min(good, len(labels) - good) >= 10 else np.zeros(len(labels), dtype=bool)
    counts = np.full((2, DIMENSIONS), smooth)
    for k, r in enumerate(rows):
        if not back[k]:
            counts[int(labels[k]), r] += 1
    counts /= counts.sum(axis=1, keepdims=True)
    ratio = np.log(counts[1] / counts[0])
    fit = np.flatnonzero(~back)
    signs = np.where(labels[fit] == 1, 1.0, -1.0)
    each = np.where(signs > 0, len(fit) / (2 * (signs > 0).sum()), len(fit) / (2 * (signs < 0).sum())) * cost
    w, bias = _dual_descent([rows[k] for k in fit], signs, ratio, each, epochs, seed)
    model = NBSVM((w * ratio).astype(np.float32), bias, 1.0, 0.0)
    judged = np.flatnonzero(back) if back.any() else fit
    slope, offset = _logistic(np.array([model.margin(rows[k]) for k in judged]), labels[judged].astype(float))
    return NBSVM(model.weights, bias, slope, offset)


def fit_quality(docs: DataFrame, labels: DataFrame, max_rows: int = MAX_ROWS, held_out: bool = True) -> NBSVM:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, quality)``, rows of the held-out fold left out.

    At most ``max_rows`` labelled ids are taken, which are a broadcast of that bound; of several texts with one id the least counts. Labels that are NULL or neither 0 nor 1 are not used, of a
    label that repeats the smaller one counts, labels without a document are idle.
    """
    usable = labels.where("quality IN (0, 1) AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    if held_out:
        usable = usable.where(id_fold(F.col("doc_id"), FOLDS) != HELD_OUT)
    sample = first_by_hash(usable, max_rows)

    def featurise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "quality": batch["quality"], "places": [features(t) for t in batch["text"]]})

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(batches) or [pd.DataFrame(columns=["doc_id", "quality", "places"])], ignore_index=True)
        rows = rows.sort_values("doc_id", kind="stable", ignore_index=True)
        model = train([np.asarray(p, dtype=np.int64) for p in rows["places"]], rows["quality"].to_numpy(dtype=int))
        yield pd.DataFrame({"weights": [model.weights.tobytes()], "bias": [model.bias], "slope": [model.slope], "offset": [model.offset]})

    # One text for an id, however many rows have it: the fit gets no more rows than ids.
    chosen = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text"))
    placed = chosen.mapInPandas(featurise, "doc_id long, quality int, places array<int>")
    got = placed.repartition(1).mapInPandas(fit, "weights binary, bias double, slope double, offset double").first()
    if got is None:
        return train([], np.empty(0, dtype=int))
    return NBSVM(np.frombuffer(got["weights"], dtype=np.float32), got["bias"], got["slope"], got["offset"])


def quality_score(model: NBSVM, docs: DataFrame, text: str = "text") -> Column:
    """The probability of label 1 for the texts of ``docs``; the model (1 MB) is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(shared.value.score, na_action=None).astype(float)

    return of(F.col(text))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_rows: int = MAX_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row of ``docs(doc_id, text)``, scored by its whole text alone.

    NULL, empty and blank texts have no feature and get the score of the bias. Rows that repeat are scored each; a NULL id
    is scored like any other. Other columns are ignored. An empty table gives an empty result.
    """
    model = fit_quality(docs, labels, max_rows)
    scored = docs.select("doc_id", (id_fold(F.col("doc_id"), FOLDS) == HELD_OUT).alias("held_out"), quality_score(model, docs).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
