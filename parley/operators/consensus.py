"""Consensus labels, calibration, outliers and reliability of ordinal ratings 1 to 4."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEVELS = (1, 2, 3, 4)
ITEM = ("conv_id", "utterance_id", "aspect")


def _counts(df: DataFrame, *by: str, column: str = "rating") -> DataFrame:
    return df.groupBy(*by).agg(*(F.count_if(F.col(column) == k).alias(f"c{k}") for k in LEVELS), F.count("*").alias("n"), F.median(column).alias("med"), F.avg(column).alias("mean"), F.min(column).alias("lo"), F.max(column).alias("hi"))


def consensus_labels(ratings: DataFrame, alpha: float = 1.0) -> DataFrame:
    """Soft and hard label of every item.

    Dirichlet-smoothed probabilities, their mean, confidence as one less normalised entropy, a hard label (two ratings:
    mean, a half rounded down; else the median if whole; else the most frequent level, the lowest of those that tie),
    and masks of the thresholds that the range of ratings leaves open.
    """
    out = _counts(ratings, *ITEM)
    for k in LEVELS:
        out = out.withColumn(f"p{k}", (F.col(f"c{k}") + alpha) / (F.col("n") + 4 * alpha))
    entropy = -sum(F.col(f"p{k}") * F.ln(F.greatest(F.col(f"p{k}"), F.lit(1e-12))) for k in LEVELS)
    most = F.greatest(*(f"c{k}" for k in LEVELS))
    top = F.coalesce(*(F.when(F.col(f"c{k}") == most, k) for k in LEVELS))
    hard = F.when(F.col("n") == 2, F.floor("mean")).when(F.col("med") == F.floor("med"), F.col("med")).otherwise(top).cast("int")
    masks = [F.when((F.col("lo") <= k) & (k < F.col("hi")), 0).otherwise(1).alias(f"mask_t{k}") for k in (1, 2, 3)]
    return out.select(*ITEM, F.col("n").alias("n_raters"), hard.alias("y_hard"), F.round(1 - entropy / F.ln(F.lit(4.0)), 6).alias("w_conf"), F.round(sum(k * F.col(f"p{k}") for k in LEVELS), 6).alias("y_cont"), *(F.round(f"p{k}", 6).alias(f"p{k}") for k in LEVELS), "lo", "hi", *masks)


def rater_pairs(ratings: DataFrame, *by: str) -> DataFrame:
    """Ratings of two raters of one item, each pair once; the items' key spreads the join."""
    a = ratings.select(*ITEM, F.col("rater_id").alias("ra"), F.col("rating").alias("x"))
    b = ratings.select(*ITEM, F.col("rater_id").alias("rb"), F.col("rating").alias("y"))
    return a.join(b, list(ITEM)).where("ra < rb")


def alpha(ratings: DataFrame, *by: str) -> DataFrame:
    """Krippendorff's alpha by group for interval and nominal distance, from level counts of items with two ratings or more."""
    items = _counts(ratings, *ITEM).where("n >= 2")
    pairs = {(i, j): F.sum((F.col(f"c{i}") * F.col(f"c{j}") - (F.col(f"c{i}") if i == j else 0)) / (F.col("n") - 1)).alias(f"o{i}{j}") for i in LEVELS for j in LEVELS}
    o = items.groupBy(*by).agg(*pairs.values())
    m = {i: sum(F.col(f"o{i}{j}") for j in LEVELS) for i in LEVELS}
    n = sum(m.values())
    out = []
    for name, distance in (("interval", lambda i, j: (i - j) ** 2), ("nominal", lambda i, j: int(i != j))):
        seen = sum(F.col(f"o{i}{j}") * distance(i, j) for i in LEVELS for j in LEVELS)
        chance = sum(m[i] * m[j] * distance(i, j) for i in LEVELS for j in LEVELS)
        out.append(F.round(1 - (n - 1) * F.try_divide(seen, chance), 6).alias(f"alpha_{name}"))
    # Ordinal distances come from the levels' own shares: squared difference of cumulative mid-ranks.
    mid = {k: sum((m[j] for j in LEVELS if j < k), F.lit(0.0)) + m[k] / 2 for k in LEVELS}
    seen = sum(F.col(f"o{i}{j}") * F.pow(mid[i] - mid[j], 2) for i in LEVELS for j in LEVELS)
    chance = sum(m[i] * m[j] * F.pow(mid[i] - mid[j], 2) for i in LEVELS for j in LEVELS)
    return o.select(*by, *out, F.round(1 - (n - 1) * F.try_divide(seen, chance), 6).alias("alpha_ordinal"))


def centre(ratings: DataFrame) -> DataFrame:
    """Ratings as z-scores of their rater, rescaled to the aspect's mean and deviation, rounded half to even, clipped.

    Moments are aggregated, a row per rater and aspect, and joined back, so that no task holds an aspect.
    """
    moments = lambda name: [F.avg("rating").alias(f"{name}_mean"), F.stddev_pop("rating").alias(f"{name}_sd")]
    own, all_ = ratings.groupBy("aspect", "rater_id").agg(*moments("own")), ratings.groupBy("aspect").agg(*moments("all"))
    z = (F.col("rating") - F.col("own_mean")) / F.coalesce(F.nullif("own_sd", F.lit(0.0)), F.lit(1.0))
    moved = F.round(z * F.coalesce(F.nullif("all_sd", F.lit(0.0)), F.lit(1.0)) + F.col("all_mean"), 6)
    joined = ratings.join(own.join(all_, "aspect"), ["aspect", "rater_id"])
    return joined.select(*ITEM, "rater_id", "rating", F.least(F.lit(4), F.greatest(F.lit(1), F.bround(moved, 0).cast("int"))).alias("calibrated"))


def link_quantiles(ratings: DataFrame, *within: str) -> DataFrame:
    """Each rater's levels moved to the level of the aspect whose cumulative share is nearest, never downwards.

    Shares are those `within` columns and aspect. Works on level counts, a row per rater and aspect.
    """
    group = [*within, "aspect"]
    cdf = [F.round(sum(F.col(f"c{j}") for j in LEVELS if j <= k) / F.col("n"), 9).alias(f"f{k}") for k in LEVELS]
    own = _counts(ratings, *group, "rater_id").select(*group, "rater_id", *cdf)
    all_ = _counts(ratings, *group).select(*group, F.array(*cdf).alias("g"))
    near = lambda k: F.expr(f"array_min(transform(g, (v, i) -> named_struct('d', round(abs(v - f{k}), 9), 'k', i + 1))).k")
    steps = [near(k) for k in LEVELS]
    out = own.join(all_, group).select(*group, "rater_id", *(F.greatest(*steps[:k], F.lit(1)).alias(f"to{k}") for k in LEVELS))
    to = F.coalesce(*(F.when(F.col("rating") == k, F.col(f"to{k}")) for k in LEVELS))
    return ratings.join(out, [*group, "rater_id"]).select(*ITEM, "rater_id", "rating", to.cast("int").alias("calibrated"))


def leave_one_out(ratings: DataFrame) -> DataFrame:
    """Mean absolute and squared error of each rater against the mean of an item's other raters, by aspect.

    Others' means come from the item's sum less the own rating, so no pair of raters is formed.
    """
    item = Window.partitionBy(*ITEM)
    others = ratings.select("aspect", "rater_id", "rating", (F.sum("rating").over(item) - F.col("rating")).alias("s"), (F.count("*").over(item) - 1).alias("n")).where("n > 0")
    error = F.col("rating") - F.col("s") / F.col("n")
    return others.groupBy("aspect", "rater_id").agg(F.round(F.avg(F.abs(error)), 6).alias("mae"), F.round(F.avg(error * error), 6).alias("mse"), F.count("*").alias("n_items"))


def human_range(ratings: DataFrame) -> DataFrame:
    """Mean and population deviation over raters of their leave-one-out error, by aspect."""
    return leave_one_out(ratings).groupBy("aspect").agg(F.round(F.avg("mae"), 5).alias("mean_mae"), F.round(F.stddev_pop("mae"), 5).alias("sd_mae"), F.count("*").alias("n_raters"))


def majority(ratings: DataFrame, least: int = 2, ties: str = "skip") -> DataFrame:
    """The most frequent level of items with `least` raters or more; of levels that tie the lowest (`min`) or highest (`max`), or the item is left out (`skip`)."""
    if ties not in ("skip", "min", "max"):
        raise ValueError(f"unknown rule for ties: {ties}")
    out = _counts(ratings, *ITEM).where(F.col("n") >= least).withColumn("most", F.greatest(*(f"c{k}" for k in LEVELS)))
    tops = sum((F.col(f"c{k}") == F.col("most")).cast("int") for k in LEVELS)
    out = out.where(tops == 1) if ties == "skip" else out
    return out.select(*ITEM, F.coalesce(*(F.when(F.col(f"c{k}") == F.col("most"), k) for k in (reversed(LEVELS) if ties == "max" else LEVELS))).alias("vote"))


def crosstab(pairs: DataFrame, *by: str, levels: tuple[int, ...] = LEVELS) -> DataFrame:
    """(by, x, y, n, row_share, column_share, share): counts of every pair of levels, those that don't occur included."""
    counts = pairs.groupBy(*by).agg(*(F.count_if((F.col("x") == i) & (F.col("y") == j)).alias(f"n{i}{j}") for i in levels for j in levels))
    n = lambda where: sum((F.col(f"n{i}{j}") for i in levels for j in levels if where(i, j)), F.lit(0))
    part = lambda i, j, total: F.round(F.try_divide(F.col(f"n{i}{j}"), total), 6)
    cells = [F.struct(F.lit(i).alias("x"), F.lit(j).alias("y"), F.col(f"n{i}{j}").alias("n"), part(i, j, n(lambda a, b, i=i: a == i)).alias("row_share"), part(i, j, n(lambda a, b, j=j: b == j)).alias("column_share"), part(i, j, n(lambda a, b: True)).alias("share")) for i in levels for j in levels]
    return counts.select(*by, F.inline(F.array(*cells)))


def confusion(ratings: DataFrame) -> DataFrame:
    """How often each vote's items got each rating, by aspect, with the row's share."""
    joined = ratings.join(majority(ratings), list(ITEM)).groupBy("aspect", "vote", "rating").agg(F.count("*").alias("n"))
    return joined.select("*", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("aspect", "vote")), 6).alias("share"))
