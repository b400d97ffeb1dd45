"""Features of utterances, runs of turns, spans and the ranking of segments."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_BEFORE = (Window.unboundedPreceding, -1)


def n_words(text: Column) -> Column:
    return F.size(F.filter(F.split(text, r"\s+"), lambda w: w != "")).cast("long")


def length_normalised(rows: DataFrame) -> DataFrame:
    """Each row's total over the mean total of rows of its length; lengths are aggregated first, as a few hold most rows."""
    means = rows.groupBy("length").agg(F.avg("total").alias("mean_total"))
    return rows.join(means, "length").select("conv_id", "idx", "length", "total", F.round(F.try_divide("total", "mean_total"), 6).alias("normalised"))


def top_means(values: DataFrame, *by: str) -> DataFrame:
    """Means of a group's largest quarter, half and two values (one value at least), its harmonic mean, deviation and share >= 100.

    The harmonic mean is null unless all values are positive. Groups are ranked by sort, not gathered into lists.
    """
    group, order = Window.partitionBy(*by), Window.partitionBy(*by).orderBy(F.desc("value"))
    ranked = values.where("value IS NOT NULL").select(*by, "value", F.row_number().over(order).alias("rk"), F.count("*").over(group).alias("n"))
    top = lambda limit: F.round(F.avg(F.when(F.col("rk") <= limit, F.col("value"))), 6)
    share = lambda q: F.greatest(F.lit(1), F.ceil(F.col("n") * q))
    harmonic = F.when(F.min("value") > 0, F.count("*") / F.sum(F.when(F.col("value") > 0, 1 / F.col("value"))))
    return ranked.groupBy(*by).agg(top(share(0.25)).alias("top_quarter"), top(share(0.5)).alias("top_half"), top(F.lit(2)).alias("top_two"), F.round(harmonic, 6).alias("harmonic"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.round(F.avg((F.col("value") >= 100).cast("int")), 6).alias("share_high"))


def interaction_grid(wide: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    """Every pair of columns, and all of them (`agg`): minimum, maximum and mean of those that are not null, product and geometric mean.

    A null makes the product null; the geometric mean of a product of 0 is that of 1e-9.
    """
    out = []
    for name, of in [(f"{a}_{b}", (a, b)) for i, a in enumerate(columns) for b in columns[i + 1 :]] + [("agg", columns)]:
        cells = [F.col(c).cast("double") for c in of]
        known = F.array_compact(F.array(*cells))
        product = reduce(lambda x, y: x * y, cells)
        total = F.aggregate(known, F.lit(0.0), lambda s, x: s + x)
        parts = {"min": F.array_min(known), "max": F.array_max(known), "mean": F.try_divide(total, F.size(known)), "prod": product, "gmean": F.pow(F.when(product == 0, 1e-9).otherwise(product), 1 / len(of))}
        out += [F.round(c, 6).alias(f"{n}_{name}") for n, c in parts.items()]
    return wide.select(*keys, *out)


def interactions(wide: DataFrame, first: str, second: str, keys: list[str]) -> DataFrame:
    """Minimum, maximum, mean, product and geometric mean of two columns; null where one is."""
    a, b = F.col(first), F.col(second)
    either = lambda c: F.when(a.isNotNull() & b.isNotNull(), c)
    return wide.select(*keys, *(F.round(either(c), 6).alias(f"{first}_{second}_{n}") for n, c in (("min", F.least(a, b)), ("max", F.greatest(a, b)), ("mean", (a + b) / 2), ("product", a * b), ("gmean", F.sqrt(a * b)))))


def longest_turns(utterances: DataFrame, moderators: tuple[str, ...]) -> DataFrame:
    """Each speaker's longest run of turns that no other speaker but a moderator breaks, by words split at single spaces.

    It starts and ends with the speaker's own turns; the earliest of equal runs is taken.
    """
    order = Window.partitionBy("conv_id").orderBy("idx")
    own = utterances.where(~F.coalesce(F.col("role").isin(*moderators), F.lit(False))).select("conv_id", "idx", "role", F.size(F.split("text", " ")).alias("w"))
    changed = own.select("*", (~F.lag("role").over(order).eqNullSafe(F.col("role"))).cast("int").alias("new"))
    runs = changed.select("*", F.sum("new").over(order).alias("run")).groupBy("conv_id", "role", "run").agg(F.min("idx").alias("start"), F.max("idx").alias("end"), F.sum("w").alias("words"))
    best = F.row_number().over(Window.partitionBy("conv_id", "role").orderBy(F.desc("words"), "start"))
    return runs.withColumn("rk", best).where("rk = 1").select("conv_id", "role", "start", "end", "words")


def lag_shares(previous: DataFrame, longest: int = 5) -> DataFrame:
    """Acts by lag with their percentage within the lag and of all."""
    g = previous.where(F.col("lag").between(1, longest)).groupBy("lag", "act").agg(F.count("*").alias("n"))
    percent = lambda w: F.round(100.0 * F.col("n") / F.sum("n").over(w), 6)
    return g.select("*", percent(Window.partitionBy("lag")).alias("percent_of_lag"), percent(Window.partitionBy()).alias("percent_of_all"))


def unique_keys(rows: DataFrame) -> DataFrame:
    """Utterance ids that occur in several rows get their conversation as a suffix; counts are aggregated, then joined."""
    often = rows.groupBy("utterance_id").agg((F.count("*") > 1).alias("duplicate"))
    return rows.join(often, "utterance_id").select("conv_id", "idx", F.when(F.col("duplicate"), F.concat("utterance_id", F.lit("::"), "conv_id")).otherwise(F.col("utterance_id")).alias("utterance_id"), "duplicate")


def context_budget(utterances: DataFrame, budget: int) -> DataFrame:
    """How many words of what was said before fit beside the own words in a budget, and where the kept part starts."""
    before = F.coalesce(F.sum("n").over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(*_BEFORE)), F.lit(0))
    rows = utterances.select("conv_id", "idx", F.coalesce(n_words(F.col("text")), F.lit(0)).alias("n")).withColumn("before", before)
    kept = F.greatest(F.lit(0), F.least(F.col("before"), budget - F.col("n")))
    return rows.select("conv_id", "idx", F.col("n").alias("n_tokens"), kept.alias("context_tokens"), (F.col("before") - kept).alias("start_token"))


def intervals(starts: DataFrame, sizes: DataFrame) -> DataFrame:
    """Boundaries as intervals [start, end) numbered within the conversation; the last one ends at its number of turns."""
    order = Window.partitionBy("conv_id").orderBy("start")
    rows = starts.join(sizes, "conv_id").where("start < n")
    return rows.select("conv_id", (F.row_number().over(order) - 1).alias("segment"), "start", F.coalesce(F.lead("start").over(order), "n").alias("end"))


def mark_spans(rows: DataFrame, spans: DataFrame, closed: bool = True) -> DataFrame:
    """Rows with the last segment whose span covers their place, its end included if `closed`; null outside all spans."""
    upto = F.col("idx") <= F.col("end") if closed else F.col("idx") < F.col("end")
    s = spans.select(F.col("conv_id").alias("c"), "segment", "start", "end")
    met = rows.join(s, (F.col("conv_id") == F.col("c")) & (F.col("idx") >= F.col("start")) & upto, "left")
    return met.groupBy("conv_id", "idx").agg(F.max("segment").alias("segment"))


#: Segments of a group of conversations, about.
SEGMENTS = 20_000


def merge_segments(segments: DataFrame, least: int = 450, most: int = 750, turns: int = 25) -> DataFrame:
    """Neighbouring segments (conv_id, segment, start, end, words, n_turns) merged while that brings the words nearer to the range.

    A segment joins the one before it if the joint distance to [least, most] words is strictly smaller and the turns
    do not exceed `turns`. Each step depends on the last, so a conversation is one task's, of the size of its segments;
    many conversations are one group, dealt by hash, for a group costs more than a conversation.
    """
    away = lambda words: max(least - words, words - most, 0)

    def fold(key, rows: pd.DataFrame) -> pd.DataFrame:
        done: list[list] = []
        for s in rows.sort_values(["conv_id", "segment"]).itertuples():
            conv = None if pd.isna(s.conv_id) else int(s.conv_id)
            last = done[-1] if done and done[-1][0] == conv else None
            if last and away(last[4] + s.words) < away(last[4]) and last[5] + s.n_turns <= turns:
                last[3:] = [s.end, last[4] + s.words, last[5] + s.n_turns]
            else:
                done.append([conv, last[1] + 1 if last else 0, s.start, s.end, s.words, s.n_turns])
        return pd.DataFrame(done, columns=["conv_id", "segment", "start", "end", "words", "n_turns"]).astype({"conv_id": "Int64"})

    bundles = max(1, segments.count() // SEGMENTS)
    dealt = segments.withColumn("bundle", F.pmod(F.xxhash64("conv_id"), F.lit(bundles)))
    return dealt.groupBy("bundle").applyInPandas(fold, "conv_id long, segment long, start long, end long, words long, n_turns long")


#: What each scaled column adds to a segment's quality and cost.
QUALITY = {"overall_mean": 0.2, "sum_score": 0.2, "overall_std": 0.2, "participant_count": 0.2, "segment_confidence": 0.2}
COST = {"read_time_dev": 0.3, "utt_count_dev": 0.2, "skipped_token_ratio": 0.5, "skipped_utterances_ratio": 0.25}


def worth(segments: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Segments ranked in their conversation by quality over cost, after scaling each column to 0..1 within it.

    A constant column counts as zero; the lower segment comes first among equals.
    """
    conv = Window.partitionBy("conv_id")
    scaled = {c: F.coalesce(F.try_divide(F.col(c) - F.min(c).over(conv), F.max(c).over(conv) - F.min(c).over(conv)), F.lit(0.0)) for c in (*QUALITY, *COST)}
    rows = segments.select("conv_id", "segment", *(v.alias(c) for c, v in scaled.items()))
    total = lambda weights: sum(F.col(c) * w for c, w in weights.items())
    rows = rows.select("conv_id", "segment", F.round(total(QUALITY) / (1 + alpha * total(COST)), 6).alias("worth"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id").orderBy(F.desc("worth"), "segment")))
