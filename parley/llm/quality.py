"""Quality filtering by weak supervision.

Rules look at a text's statistics and vote that it is good, vote that it is bad, or abstain. Expectation-maximisation
over the counts of distinct vote patterns (3 ** rules at most, whatever the corpus' size) estimates how often each rule
gives each vote on good and on bad texts; a text is kept if its posterior probability of being good is high enough.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import scratch

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
_SYMBOLS, _SPACES = list(b"#*$%&|<>"), list(b"\x20\x09\x0a\x0b\x0c\x0d")
_ENDS = ".,;:!?\"')"
_BLANK = re.compile(r"[\x20\x09-\x0D]*\Z")

#: (signal, good from, bad from): a rule votes good up to its first bound, bad from its second on, and abstains between.
#: Most rules only know what bad text looks like: their first bound is below every value, so that silence is no praise.
RULES = [
    ("symbol_share", -1.0, 0.05),
    ("shout_share", -1.0, 0.50),
    ("repeat_share", -1.0, 0.30),
    ("dup_line_share", -1.0, 0.30),
    ("top_word_share", -1.0, 0.30),
    ("odd_word_share", 0.05, 0.25),
    ("short_word_lack", 0.85, 0.95),
    ("odd_word_length", 3.0, 6.0),
]
SIGNALS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, votes int"


def statistics(text: str | None) -> tuple[int, int, int, int, int, list[float]]:
    """The five counts of a text, then one value for each rule. Null has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words, of_byte = raw.split(), np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    n, symbols = len(words), int(of_byte[_SYMBOLS].sum())
    if not n:
        return 0, 0, symbols, 0, 0, [0.0] * len(RULES)
    chars = int(of_byte.sum() - of_byte[_SPACES].sum() - of_byte[0x80:0xC0].sum())  # no continuation bytes
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if not _BLANK.match(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), dtype=np.int64, count=n)
    repeats = 0
    if n >= 3:
        windows = (at[:-2] * len(ids) + at[1:-1]) * len(ids) + at[2:] if len(ids) < 2_000_000 else np.unique(np.stack([at[:-2], at[1:-1], at[2:]]), axis=1, return_inverse=True)[1].ravel()
        order = np.argsort(windows)
        same = windows[order][1:] == windows[order][:-1]
        twice = np.zeros(n - 2, dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(n, dtype=bool)
        for k in range(3):
            covered[k : n - 2 + k] |= twice
        repeats = int(covered.sum())
    used = np.bincount(at)
    kinds = [(w.rstrip(_ENDS).isalpha(), len(w) <= 4) for w in b" ".join(ids).decode("utf-8", "replace").split(" ")]
    plain, short = (int(used[np.array([k[i] for k in kinds])].sum()) for i in (0, 1))
    upper, lower = int(of_byte[0x41:0x5B].sum()), int(of_byte[0x61:0x7B].sum())
    values = [symbols / chars, upper / max(1, upper + lower), repeats / n, dup / lines, float(used.max()) / n if n >= 20 else 0.0, 1 - plain / n, 1 - short / n, abs(chars / n - 5.5)]
    return n, chars, symbols, dup, repeats, values


def vote(values: list[float]) -> int:
    """Votes of all rules as one number: a digit to base 3 for each rule."""
    return sum((2 if v <= good else 0 if v >= bad else 1) * 3**k for k, (v, (_, good, bad)) in enumerate(zip(values, RULES, strict=True)))


@dataclass
class Model:
    """What expectation-maximisation found: the share of good texts, and P(vote | class) for each rule."""

    good: float
    rates: np.ndarray = field(repr=False)  # rules x (bad, good) x (votes bad, abstains, votes good)

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        """P(good | votes) for patterns (rows) of digits 0, 1, 2."""
        logs = np.log(self.rates)
        by_class = [np.log(p) + sum(logs[k, c, patterns[:, k]] for k in range(patterns.shape[1])) for c, p in ((0, 1 - self.good), (1, self.good))]
        return 1 / (1 + np.exp(np.clip(by_class[0] - by_class[1], -700, 700)))


def digits(codes: np.ndarray, rules: int) -> np.ndarray:
    return np.stack([codes // 3**k % 3 for k in range(rules)], axis=1)


def fit(codes: np.ndarray, counts: np.ndarray, rules: int = len(RULES), rounds: int = 100) -> Model:
    """Estimate a model from how many texts have each vote pattern.

    Starts from the votes' majority with any bad vote weighing more, and keeps a little prior mass on every rate, with
    more of it on votes that agree with the class, so that classes don't change places and no rate becomes zero.
    """
    patterns, weights = digits(codes, rules), counts.astype(float)
    prior = np.array([[2.0, 1.0, 0.5], [0.1, 1.0, 4.0]])
    bad, fine = (patterns == 0).sum(axis=1), (patterns == 2).sum(axis=1)
    post = 1 / (1 + np.exp(2.0 * bad - 0.5 * fine + 0.5))
    model = Model(0.5, np.full((rules, 2, 3), 1 / 3))
    for _ in range(rounds):
        rates = np.empty((rules, 2, 3))
        for c, share in enumerate((1 - post, post)):
            for k in range(rules):
                rates[k, c] = np.bincount(patterns[:, k], weights=weights * share, minlength=3) + prior[c]
        rates /= rates.sum(axis=2, keepdims=True)
        model = Model(float(np.clip((weights * post).sum() / max(1.0, weights.sum()), 0.05, 0.99)), rates)
        after = model.posterior(patterns)
        if np.abs(after - post).max(initial=0) < 1e-9:
            break
        post = after
    return model


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, probability) per row.

    base_failed: fewer than 50 words, or over half the words in 3-word windows that occur twice or more. kept is false
    if base_failed, else whether the posterior is `threshold` or more. Null and empty texts have no words and fail.
    Repeated rows stay; other columns are not read; no rows give no rows. One rule that votes alike on all texts
    moves no posterior much; if all texts are alike, the prior decides, which keeps texts that no rule votes against.
    """

    names = [x.split()[0] for x in SIGNALS.split(", ")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            found = np.array([(*s[:5], vote(s[5])) for s in map(statistics, rows.column("text").to_pylist())], dtype=np.int64).reshape(-1, 6).T
            yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in found[:5]), pa.array(found[5].astype(np.int32)), rows.column("doc_id")], [*names, "doc_id"])

    id_type = dict(docs.select(F.col(id_col).alias("doc_id")).dtypes)["doc_id"]
    own = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    signals = scratch.write_and_read(own.mapInArrow(read, f"{SIGNALS}, doc_id {id_type}"), "signals")
    # At most 3 ** rules rows.
    seen = signals.where(f"n_words >= {MIN_WORDS}").groupBy("votes").count().toPandas()
    model = fit(seen["votes"].to_numpy(dtype=np.int64), seen["count"].to_numpy())
    every = np.arange(3 ** len(RULES))
    table = docs.sparkSession.createDataFrame(pd.DataFrame({"votes": every.astype(np.int32), "probability": model.posterior(digits(every, len(RULES)))}), "votes int, probability double")
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return signals.join(F.broadcast(table), "votes").select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("probability") >= threshold)).alias("kept"), "probability")
