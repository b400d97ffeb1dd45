"""Segmentation of conversations."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def votes(starts: DataFrame, n_runs: int, sizes: DataFrame) -> DataFrame:
    """Boundary score of each place from the starts that runs propose: one at the start, a half beside it, by run.

    `sizes` (conv_id, n): a conversation's last place is never scored.
    """
    spread = starts.select("conv_id", F.explode(F.array(*(F.struct((F.col("idx") + d).alias("idx"), F.lit(w).alias("w")) for d, w in ((-1, 0.5), (0, 1.0), (1, 0.5))))).alias("v"))
    inside = spread.select("conv_id", "v.*").join(sizes, "conv_id").where("idx >= 0 and idx < n - 1")
    return inside.groupBy("conv_id", "idx").agg(F.round(F.sum("w") / n_runs, 6).alias("score"))


def choose_starts(scores: list[float], tau: float, least: int, most: int) -> list[tuple[int, float]]:
    """(place, confidence) of each segment's start, the first at 0 with confidence 1.

    A peak scores `tau` or more and no less than its neighbours. From one start the next lies `least` on or more and leaves
    `least` to the last place. While the rest is longer than `most`, the best peak up to `most` on is next, or without one the
    best place; a shorter rest is cut only at a peak, its best. Of places that tie the rightmost is taken.
    """
    last = len(scores) - 1
    peaks = {i for i in range(1, last) if scores[i] >= max(tau, scores[i - 1], scores[i + 1])}
    out = [(0, 1.0)]
    while True:
        at = out[-1][0]
        must = last - at > most
        stop = min(last - least, last - 1, at + most if must else last)
        window = range(at + least, stop + 1)
        options = [i for i in window if i in peaks] or (list(window) if must else [])
        if not options:
            return out
        out.append(max(((i, scores[i]) for i in options), key=lambda p: (p[1], p[0])))


def pick_boundaries(scores: DataFrame, sizes: DataFrame, tau: float = 0.5, least: int = 2, most: int = 12) -> DataFrame:
    """(conv_id, segment, start, end, confidence) of each segment; `end` is the next start, or the last place.

    Each choice depends on the one before, so a conversation is one task's group; its size is that of its turns. Places
    without a score have zero. A conversation without turns has one segment at 0.
    """

    def pick(key, rows: pd.DataFrame) -> pd.DataFrame:
        n = int(rows["n"].iloc[0])
        known = rows.dropna(subset=["idx"])
        dense = np.zeros(n)
        dense[known["idx"].astype(int)] = known["score"]
        starts = choose_starts(dense.tolist(), tau, least, most)
        ends = [*(s for s, _ in starts[1:]), max(0, n - 1)]
        return pd.DataFrame({"conv_id": key[0], "segment": range(len(starts)), "start": [s for s, _ in starts], "end": ends, "confidence": [c for _, c in starts]})

    return sizes.join(scores, "conv_id", "left").groupBy("conv_id").applyInPandas(pick, "conv_id long, segment long, start long, end long, confidence double")
