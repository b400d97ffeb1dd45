"""Toxicity by a character n-gram linear classifier with naive Bayes features.

A text's features are the hashed character n-grams that occur in it. Each is scaled by its naive Bayes log-count ratio
between toxic and other training texts, and a logistic regression is fitted on the scaled features.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import scratch

ORDERS = (4, 5, 6)
BITS = 18
#: At most so many labelled texts of each class train a model, and so many features stay in it.
MAX_PER_CLASS = 2000
MAX_FEATURES = 2048
FOLDS, HELD_OUT = 5, 0


def gram_hashes(text: str, orders: tuple[int, ...] = ORDERS, bits: int = BITS) -> np.ndarray:
    """Hash of every n-gram of a text's UTF-8 bytes after lower-casing and joining runs of white space."""
    raw = f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass")
    codes = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    found, rolling = [], codes
    for n in range(2, max(orders) + 1):
        if len(codes) < n:
            break
        rolling = rolling[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
        if n in orders:
            found.append(((rolling * np.uint32(0x9E3779B1)) ^ np.uint32(n * 0x85EBCA6B & 0xFFFFFFFF)) * np.uint32(0xC2B2AE35) >> np.uint32(32 - bits))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


@dataclass
class Model:
    """slots: for each hash the place of its feature, -1 for none; weights already hold the log-count ratios."""

    slots: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        """Probability that a text is toxic; a text without any feature (null, empty) gets what the bias gives."""
        has = np.zeros(len(self.weights) + 1, dtype=bool)  # slot -1, for no feature, is the last
        has[self.slots[gram_hashes(text or "")]] = True
        total = self.bias + float(self.weights[has[:-1]].sum())
        return float(1 / (1 + np.exp(-np.clip(total, -500, 500))))


def packed(text: str | None) -> bytes:
    """The distinct hashes of a text, 2**BITS at most whatever its length, as compressed steps from one to the next."""
    return zlib.compress(np.diff(np.unique(gram_hashes(text or "")).astype(np.int64), prepend=0).astype("<u4").tobytes(), 1)


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zlib.decompress(blob), dtype="<u4").astype(np.int64))


def fit(texts: list[str], labels: np.ndarray, max_features: int = MAX_FEATURES, penalty: float = 1e-3, rounds: int = 300) -> Model:
    """Fit on texts and 0/1 labels."""
    return fit_packed([packed(t) for t in texts], labels, max_features, penalty, rounds)


def fit_packed(rows: list[bytes], labels: np.ndarray, max_features: int = MAX_FEATURES, penalty: float = 1e-3, rounds: int = 300) -> Model:
    """Fit on texts' packed hashes and 0/1 labels. With no text of one class, the model gives that class' share everywhere."""
    labels = np.asarray(labels, dtype=float)
    n1, n0 = labels.sum(), (1 - labels).sum()
    slots = np.full(1 << BITS, -1, dtype=np.int16)
    if not n1 or not n0:
        return Model(slots, np.zeros(0), 20.0 if n1 else -20.0)
    seen = np.zeros((2, 1 << BITS))
    for r, y in zip(rows, labels, strict=True):
        seen[int(y), unpacked(r)] += 1
    # Bernoulli log-count ratio, smoothed by one; its support decides which features stay.
    p1, p0 = (seen[1] + 1) / (n1 + 2), (seen[0] + 1) / (n0 + 2)
    ratio = np.log(p1 / (1 - p1)) - np.log(p0 / (1 - p0))
    gain = np.abs(p1 - p0) / np.sqrt((p1 * (1 - p1)) / n1 + (p0 * (1 - p0)) / n0)
    gain[seen.sum(axis=0) < max(3, 0.002 * len(rows))] = 0
    best = np.argsort(-gain, kind="stable")[:max_features]
    best = best[gain[best] > 0]
    slots[best] = np.arange(len(best))
    x = np.zeros((len(rows), len(best)), dtype=np.float32)
    for row, r in enumerate(rows):
        at = slots[unpacked(r)]
        x[row, at[at >= 0]] = 1
    x *= ratio[best].astype(np.float32)
    w, bias = np.zeros(len(best), dtype=np.float64), float(np.log(n1 / n0))
    balance = np.where(labels > 0, 0.5 / n1, 0.5 / n0)
    bias = 0.0
    # Accelerated gradient steps whose length the largest singular value bounds.
    v = np.random.default_rng(0).normal(size=len(best)).astype(np.float32)
    for _ in range(20):
        u = x.T @ (balance.astype(np.float32) * (x @ v))
        v = u / max(1e-12, float(np.linalg.norm(u)))
    step = 1 / (0.25 * float(v @ (x.T @ (balance.astype(np.float32) * (x @ v)))) + 0.25 + penalty)
    at_w, at_b = w.copy(), bias
    for k in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ at_w.astype(np.float32) + at_b, -50, 50)))
        slope = balance * (p - labels)
        new_w = at_w - step * (x.T @ slope.astype(np.float32) + penalty * at_w)
        new_b = at_b - step * slope.sum()
        push = k / (k + 3)
        at_w, at_b = new_w + push * (new_w - w), new_b + push * (new_b - bias)
        w, bias = new_w, new_b
    return Model(slots, w * ratio[best], float(bias))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_per_class: int = MAX_PER_CLASS) -> Model:
    """Fit on the labelled texts outside the held-out fold: at most `max_per_class` of each class, those of least id hash.

    Of rows that share an id, that of the least text hash counts; of labels that do, a toxic one. The driver gets hashes of a
    bounded size, not texts.
    """
    fold = F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(FOLDS))
    own = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y")).where(F.col("y").isin(0, 1) & F.col("doc_id").isNotNull())
    own = own.where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT).groupBy("doc_id").agg(F.max("y").alias("y"))
    # The least hashes of a class lie far below this share of all hashes, so the sort meets a few thousand rows at any size.
    sizes = dict(own.groupBy("y").count().collect())  # two rows at most
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5
    first = [own.where((F.col("y") == y) & (place < 4.0 * max_per_class / sizes.get(y, 1))).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_per_class) for y in (0, 1)]
    chosen = F.broadcast(first[0].unionByName(first[1]))  # 2 * max_per_class rows at most
    texts = docs.where(fold != HELD_OUT).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = texts.join(chosen, "doc_id").groupBy("doc_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("r")).select("doc_id", "r.y", F.udf(packed, "binary")("r.text").alias("x")).orderBy("doc_id").collect()
    model = fit_packed([bytes(r.x) for r in rows], np.array([r.y for r in rows]))
    del rows
    scratch.sweep(docs.sparkSession)
    return model


def score_column(docs: DataFrame, model: Model):
    """A vectorised function from a text column to its score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(texts: pd.Series) -> pd.Series:
        return pd.Series([shared.value.score(t) for t in texts], dtype="float64")

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row. Null ids are not held out; repeated rows stay."""
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    own = docs.select(F.col(id_col).alias("doc_id"), score_column(docs, model)(F.col(text_col)).alias("score"))
    return own.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, that the model scores below one half."""
    return docs.where(score_column(docs, model)(F.col(text_col)) < 0.5)
