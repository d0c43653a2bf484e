"""Toxicity: a linear classifier on character n-grams scaled by log-count ratios.

The classifier is fitted on a bounded sample of the labelled training rows, taken by
hash of the id: at most COUNTED rows of either class. Their ids go to the texts, so
no text is shuffled. Presence of character n-grams (hashed into a fixed number of
slots) is counted per class. The naive Bayes log-count ratio of a slot is the scale
of its feature; the slots that tell the classes apart best are the features. A
logistic regression over the scaled features is fitted on the first SAMPLE rows of
either class, weighted to the classes' sizes among all training rows, and scores
every text in one pass. Labels are only read for training rows; nothing but
the text goes into a score.

Defined cases: a null or empty text has no feature and gets the score of the
intercept; null labels are ignored, of several labels of a document the largest
counts; without training rows of both classes every score is the share of toxic
rows seen (0.5 without any); repeated rows get equal scores.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import saved

#: Lengths of the n-grams in characters, and slots they are hashed into (a power of two).
SHORTEST, LONGEST = 3, 6
SLOT_BITS = 19
#: Slots that become features, and training texts of each class that are fitted.
FEATURES, SAMPLE = 3000, 3000
#: Training texts of each class whose n-grams are counted (12 bytes each are sent).
COUNTED = 20_000
SMOOTHING = 1.0
#: Texts a slot must occur in.
MIN_TEXTS = 3
ROUNDS, RIDGE = 400, 2e-3
FOLDS = 5

_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_STEP = np.uint32(0x01000193)
_SPREAD = np.uint32(0x9E3779B1)


def slots(text: str | None) -> np.ndarray:
    """Slot of every n-gram of a text; A-Z lower-cased, white space runs as one space."""
    if not text:
        return np.empty(0, np.uint32)
    data = f" {' '.join(text.translate(_LOWER).split())} ".encode("utf-32-le", "surrogatepass")
    chars = np.frombuffer(data, np.uint32) + np.uint32(1)
    out, rolled = [], chars
    for n in range(2, LONGEST + 1):
        if len(chars) < n:
            break
        rolled = rolled[: len(chars) - n + 1] * _STEP ^ chars[n - 1 :]
        if n >= SHORTEST:
            mixed = rolled ^ (rolled >> np.uint32(15))
            mixed = mixed * _SPREAD
            out.append(mixed >> np.uint32(32 - SLOT_BITS))
    return np.concatenate(out) if out else np.empty(0, np.uint32)


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


@dataclass(frozen=True)
class Model:
    """Feature number of each slot (-1 for none), weight of each feature, intercept."""

    feature_of: np.ndarray
    weights: np.ndarray
    intercept: float

    def present(self, text: str | None) -> np.ndarray:
        found = self.feature_of[slots(text)]
        return np.unique(found[found >= 0])

    def score(self, text: str | None) -> float:
        z = self.intercept + float(self.weights[self.present(text)].sum())
        return 1.0 / (1.0 + math.exp(-z)) if z > -700 else 0.0


def _ratios(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """Log-count ratio of each slot, from texts of class 0 and 1 that have it."""
    share = (counts + SMOOTHING) / (totals + 2 * SMOOTHING)
    return np.log(share[:, 1] / share[:, 0])


def _evidence(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """How far presence of a slot tells the classes apart (a likelihood ratio)."""
    seen = counts.sum(1, keepdims=True)
    all_texts = totals.sum()
    out = np.zeros(len(counts))
    for there in (counts, totals - counts):
        row = seen if there is counts else all_texts - seen
        expected = np.maximum(row * totals / all_texts, 1e-12)
        out += np.where(there > 0, there * np.log(np.maximum(there, 1e-12) / expected), 0.0).sum(1)
    return out


def fit(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Logistic regression with an L2 penalty, by accelerated gradient steps."""
    w = np.zeros(x.shape[1], np.float32)
    total = weight.sum()
    b = math.log((weight[y == 1].sum() + 1) / (weight[y == 0].sum() + 1))
    v = np.random.default_rng(0).standard_normal(x.shape[1]).astype(np.float32)
    for _ in range(12):
        v = x.T @ (weight * (x @ v)).astype(np.float32)
        v /= max(float(np.linalg.norm(v)), 1e-12)
    step = 4.0 / (float((weight * (x @ v) ** 2).sum()) / total + 1.0 + 4 * RIDGE)
    w_at, b_at, momentum = w, b, 1.0
    for _ in range(ROUNDS):
        p = 1.0 / (1.0 + np.exp(-np.clip(x @ w_at + b_at, -50, 50)))
        slope = (weight * (p - y)).astype(np.float32)
        w_next = w_at - step * ((x.T @ slope) / np.float32(total) + np.float32(RIDGE) * w_at)
        b_next = b_at - step * float(slope.sum()) / total
        following = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        push = (momentum - 1) / following
        w_at = (w_next + np.float32(push) * (w_next - w)).astype(np.float32)
        b_at = b_next + push * (b_next - b)
        w, b, momentum = w_next, b_next, following
    return w.astype(np.float64), b


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic 0/1)."""
    known = saved(
        labels.where("doc_id is not null and toxic is not null")
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .where(~held_out(F.col("doc_id")))
        .join(docs.select("doc_id").distinct(), "doc_id"),
        "training-labels",
    )

    def sample(most: int) -> DataFrame:
        """So many training rows of either class at most, the same on every run."""
        halves = [
            known.where(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most) for c in (0, 1)
        ]
        return F.broadcast(halves[0].union(halves[1]))

    rows = docs.select("doc_id", "text").join(sample(COUNTED), "doc_id").select("text", "toxic")
    size = 1 << SLOT_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int64)
        last = np.zeros(size, np.int64)
        for batch in batches:
            for text, toxic in zip(batch.column(0), batch.column(1).to_pylist()):
                found = slots(text.as_py())
                # The last place of each slot stands for it: every slot counts once.
                last[found] = np.arange(len(found))
                seen[toxic, found[last[found] == np.arange(len(found))]] += 1
        some = np.flatnonzero(seen.any(0))
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(seen[0, some]), pa.array(seen[1, some])], ["slot", "n0", "n1"])

    sizes = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    everything = np.array([sizes.get(0, 0), sizes.get(1, 0)], np.float64)
    totals = np.minimum(everything, COUNTED)[None, :]
    none = Model(np.full(size, -1, np.int16), np.zeros(0), 0.0)
    if totals.min() == 0:
        share = everything[1] / everything.sum() if everything.sum() else 0.5
        return Model(none.feature_of, none.weights, math.log((share + 1e-6) / (1 - share + 1e-6)))
    # One row per slot, a fixed number however many texts there are.
    table = (
        rows.mapInArrow(count, "slot long, n0 long, n1 long")
        .groupBy("slot")
        .agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1"))
        .where(F.col("n0") + F.col("n1") >= MIN_TEXTS)
        .toArrow()
    )
    slot = table.column("slot").to_numpy()
    counts = np.stack([table.column("n0").to_numpy(), table.column("n1").to_numpy()], 1).astype(np.float64)
    best = np.argsort(-_evidence(counts, totals), kind="stable")[:FEATURES]
    feature_of = np.full(size, -1, np.int16)
    feature_of[slot[best]] = np.arange(len(best), dtype=np.int16)
    ratios = _ratios(counts[best], totals)
    plain = Model(feature_of, ratios, 0.0)

    def features(batches):
        for batch in batches:
            found = [plain.present(t.as_py()).astype("<i2").tobytes() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.binary())], ["toxic", "features"])

    fitted = (
        docs.select("doc_id", "text").join(sample(SAMPLE), "doc_id").select("text", "toxic")
        .mapInArrow(features, "toxic int, features binary").toArrow()
    )
    y = fitted.column("toxic").to_numpy().astype(np.float32)
    x = np.zeros((len(y), len(best)), np.float32)
    for i, f in enumerate(fitted.column("features").to_pylist()):
        at = np.frombuffer(f, "<i2")
        x[i, at] = ratios[at]
    # Rows of either class stand for as many as there are of it.
    weight = np.where(y == 1, everything[1] / max((y == 1).sum(), 1), everything[0] / max((y == 0).sum(), 1))
    w, b = fit(x, y, weight)
    return Model(feature_of, w * ratios, b)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row of ``docs`` (doc_id, text)."""
    kept = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [kept.value.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
