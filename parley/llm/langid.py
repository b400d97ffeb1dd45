"""Language identification with string kernels.

The kernel of two texts is the number of slots of byte n-grams (1 to 4 bytes, blended) that occur in both, over the root of
the product of how many occur in each. N-grams are hashed to 2**BITS slots; those that share a slot count as one, which
bounds a text's vector whatever its script (README has how many meet in the test tables). Nyström landmarks map a text to a few kernel values; one-versus-rest kernel ridge
regression on them is solved in closed form, and texts are scored in batches as matrix products.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ORDERS = (1, 2, 3, 4)
BITS = 14
#: The bounded sample that fits a model: at most so many texts of each language, and so many of all (but one of each
#: language at least; none is left out), and so many landmarks of each.
MAX_PER_LANG, MAX_ROWS, LANDMARKS_PER_LANG = 400, 20_000, 24
#: Up to so many languages, their sizes are sent to all executors; beyond, a join shuffles ids by language.
BROADCAST_LANGS = 100_000
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
_BATCH = 128


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def presence(texts: list[str], out: np.ndarray) -> np.ndarray:
    """Set out[row, hash of n-gram] to 1 for every n-gram in each text, and the rest to 0."""
    out[: len(texts)] = 0
    for row, text in enumerate(texts):
        codes = np.frombuffer(f" {' '.join(text.lower().split())} ".encode("utf-8", "surrogatepass"), dtype=np.uint8).astype(np.uint32)
        rolling, mine = codes, out[row]
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                if len(codes) < n:
                    break
                rolling = rolling[:-1] * np.uint32(0x01000193) + codes[n - 1 :]
            if n in ORDERS:
                mine[((rolling + np.uint32(n)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)] = 1
    return out[: len(texts)]


@dataclass
class Model:
    """weights: presence vectors times these, over the root of their sizes, are the scores of `langs`.

    They are the landmarks' presence vectors times the Nyström map times the ridge coefficients, multiplied out once.
    """

    langs: list[str]
    weights: np.ndarray
    bias: np.ndarray

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNDETERMINED] * len(texts), np.zeros(len(texts))
        known = [i for i, t in enumerate(texts) if self.langs and has_letter(t)]
        space = np.zeros((min(_BATCH, max(1, len(known))), 1 << BITS), dtype=np.float32)
        for at in range(0, len(known), _BATCH):
            rows = known[at : at + _BATCH]
            x = presence([texts[i] for i in rows], space)
            margins = (x @ self.weights) / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None] + self.bias
            odds = np.exp(4 * (margins - margins.max(axis=1, keepdims=True)))
            best = margins.argmax(axis=1)
            for i, k, p in zip(rows, best, odds[np.arange(len(rows)), best] / odds.sum(axis=1), strict=True):
                langs[i], scores[i] = self.langs[k], float(p)
        return langs, scores


def packed(text: str) -> bytes:
    """A text's presence vector in 2**BITS / 8 bytes, whatever the text's length."""
    return np.packbits(presence([text], np.zeros((1, 1 << BITS), dtype=np.float32))[0] > 0).tobytes()


def fit(texts: list[str], langs: list[str], per_lang: int = LANDMARKS_PER_LANG, ridge: float = 1e-2) -> Model:
    """Fit on texts with their languages."""
    return fit_packed([packed(t) for t in texts], langs, per_lang, ridge)


def fit_packed(rows: list[bytes], langs: list[str], per_lang: int = LANDMARKS_PER_LANG, ridge: float = 1e-2) -> Model:
    """Fit on packed presence vectors with their languages; the first of each language are its landmarks. No row: no language."""
    names = sorted(set(langs))
    if not names:
        return Model([], np.zeros((1 << BITS, 0), dtype=np.float32), np.zeros(0, dtype=np.float32))

    def vectors_of(part: list[bytes]) -> np.ndarray:
        return np.unpackbits(np.frombuffer(b"".join(part), dtype=np.uint8).reshape(len(part), -1), axis=1).astype(np.float32)

    taken: dict[str, int] = {}
    marks = [i for i, lang in enumerate(langs) if taken.setdefault(lang, 0) < per_lang and not taken.update({lang: taken[lang] + 1})]
    land = vectors_of([rows[i] for i in marks])
    land /= np.sqrt(np.maximum(1, land.sum(axis=1)))[:, None]
    values, vectors = np.linalg.eigh((land @ land.T).astype(np.float64))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])  # kernel values times this: the Nyström features
    kernel = []
    for at in range(0, len(rows), _BATCH):
        x = vectors_of(rows[at : at + _BATCH])
        kernel.append((x @ land.T) / np.sqrt(np.maximum(1, x.sum(axis=1)))[:, None])
    features = np.concatenate(kernel).astype(np.float64) @ root
    index = np.array([names.index(x) for x in langs])
    target = np.where(index[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = (1 / np.bincount(index, minlength=len(names)))[index]  # every language weighs the same
    weight /= weight.sum()
    mean, centre = weight @ features, weight @ target
    x, y = features - mean, target - centre
    least = ridge * max(1e-12, float((weight @ (x**2)).mean()))  # above zero where all texts are alike
    coef = np.linalg.solve(x.T @ (weight[:, None] * x) + least * np.eye(x.shape[1]), x.T @ (weight[:, None] * y))
    return Model(names, (land.T.astype(np.float64) @ (root @ coef)).astype(np.float32), (centre - mean @ coef).astype(np.float32))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = MAX_PER_LANG, max_rows: int = MAX_ROWS) -> Model:
    """Fit outside the held-out fold on `per_lang` texts with a letter of each language (those of least id hash), all languages alike.

    With many languages each has fewer, so that about `max_rows` are fitted. The driver gets presence vectors of one size,
    not texts. Of rows that share an id, that of the least language and text hash counts.
    """
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    own = own.where("doc_id is not null and lang is not null").where(F.col("text").rlike(r"\p{L}")).where(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) != HELD_OUT)
    ids = own.select("doc_id", "lang")
    sizes = ids.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    n_langs = sizes.count()
    per_lang = max(1, min(per_lang, max_rows // max(1, n_langs)))
    sizes = F.broadcast(sizes) if n_langs <= BROADCAST_LANGS else sizes
    # The least hashes of a language lie far below this share of all hashes, so ranking meets a few thousand rows at any size.
    place = F.xxhash64("doc_id") / 2.0**64 + 0.5
    few = ids.join(sizes, "lang").where(place < (4.0 * per_lang + 40) / F.col("ids"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id"))
    chosen = few.distinct().withColumn("rank", rank).where(F.col("rank") <= per_lang).select("doc_id", "lang", "rank")
    vector = F.udf(packed, "binary")
    texts = own.join(F.broadcast(chosen), ["doc_id", "lang"])  # about max_rows at most
    texts = texts.groupBy("doc_id").agg(F.min(F.struct("lang", F.xxhash64("text"), "rank", "text")).alias("r")).select("doc_id", "r.lang", "r.rank", "r.text")
    rows = texts.select("doc_id", "lang", "rank", vector("text").alias("x")).orderBy("rank", "doc_id").collect()
    return fit_packed([bytes(r.x) for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row: `und` and score 0 where text is null or has no letter.

    Null ids are not held out; repeated rows stay; other columns are not read. A model of no language says `und` always.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            langs, scores = shared.value.predict(rows.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(langs, pa.string()), pa.array(scores)], ["doc_id", "lang_pred", "score"])

    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    out = own.mapInArrow(predict, f"doc_id {dict(own.dtypes)['doc_id']}, lang_pred string, score double")
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(FOLDS)) == HELD_OUT, F.lit(False))
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")
