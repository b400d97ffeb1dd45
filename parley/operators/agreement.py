"""Agreement between raters: outliers, final labels, rules for hard labels, pairwise and leave-one-out scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.consensus import ITEM, LEVELS, _counts, alpha, consensus_labels, crosstab, link_quantiles, rater_pairs
from parley.operators.metrics import others_label, scores

#: Which aspects are rated together, by type of task.
TASK_TYPES = {"info": ("A",), "mix": ("N", "R")}


def task_type(aspect: Column, task_types: dict = TASK_TYPES) -> Column:
    return F.coalesce(*(F.when(aspect.isin(*of), F.lit(name)) for name, of in task_types.items()))


def pair_scores(ratings: DataFrame, *by: str, overlap: int = 3) -> DataFrame:
    """Unrounded scores of each pair of raters with `overlap` shared items or more, by group; kappa is over the levels that occur."""
    return scores(rater_pairs(ratings), *by, "ra", "rb", digits=None).where(F.col("n") >= overlap)


def outlier_report(ratings: DataFrame, task_types: dict = TASK_TYPES, least: float = 0.3, slack: float = 0.5, overlap: int = 3) -> DataFrame:
    """(conv_id, task_type, rater_id, mean_qwk, n_pairs, dropped) by conversation and type of task.

    A pair's kappa is the mean over the type's aspects in which it shares enough items; a rater's is the mean over pairs. One
    below `least` goes, as does one whose mean over pairs in one aspect is `slack` lower still. A pair that agrees on one
    level throughout has no kappa, which leaves a rater's mean open, and the rater stays. Should fewer than two stay, the best
    two do, by mean, pairs and id. Aspects of no type are left out.
    """
    typed = ratings.withColumn("task_type", task_type(F.col("aspect"), task_types)).where("task_type is not null")
    none = F.lit(float("nan"))
    by_aspect = pair_scores(ratings, "conv_id", "aspect", overlap=overlap).select("conv_id", "aspect", task_type(F.col("aspect"), task_types).alias("task_type"), "ra", "rb", F.coalesce("kappa_present", none).alias("k")).where("task_type is not null")
    both = F.explode(F.array("ra", "rb")).alias("rater_id")
    key = ["conv_id", "task_type", "rater_id"]
    pairs = by_aspect.groupBy("conv_id", "task_type", "ra", "rb").agg(F.avg("k").alias("k")).select("conv_id", "task_type", "k", both)
    means = pairs.groupBy(*key).agg(F.avg("k").alias("mean"), F.count("*").alias("n_pairs"))
    aspects = by_aspect.select("conv_id", "task_type", "aspect", "k", both).groupBy(*key, "aspect").agg(F.avg("k").alias("m"))
    lowest = aspects.groupBy(*key).agg(F.max((F.col("m") < least - slack)).alias("low_aspect"))
    out = typed.select(*key).distinct().join(means, key, "left").join(lowest, key, "left")
    out = out.select(*key, F.when(~F.isnan("mean"), F.col("mean")).alias("mean_qwk"), F.coalesce("n_pairs", F.lit(0)).alias("n_pairs"), "low_aspect")
    low = F.coalesce(F.col("mean_qwk").isNotNull() & ((F.col("mean_qwk") < least) | F.col("low_aspect")), F.lit(False))
    of = Window.partitionBy("conv_id", "task_type")
    rank = F.row_number().over(of.orderBy(F.round("mean_qwk", 9).desc_nulls_last(), F.desc("n_pairs"), "rater_id"))
    marked = out.select("*", low.alias("low"), rank.alias("rank")).withColumn("stay", F.sum(F.when(F.col("low"), 0).otherwise(1)).over(of))
    return marked.select(*key, F.round("mean_qwk", 6).alias("mean_qwk"), "n_pairs", F.when(F.col("stay") < 2, F.col("rank") > 2).otherwise(F.col("low")).alias("dropped"))


def kept_ratings(ratings: DataFrame, task_types: dict = TASK_TYPES) -> DataFrame:
    """Ratings, with their type of task, of raters that the outlier report keeps."""
    gone = outlier_report(ratings, task_types).where("dropped").select("conv_id", "task_type", "rater_id")
    return ratings.withColumn("task_type", task_type(F.col("aspect"), task_types)).where("task_type is not null").join(gone, ["conv_id", "task_type", "rater_id"], "left_anti")


def final_labels(ratings: DataFrame, task_types: dict = TASK_TYPES, alpha: float = 0.5) -> DataFrame:
    """Consensus labels of the kept raters, whose levels are first linked to those of the conversation's aspect."""
    linked = link_quantiles(kept_ratings(ratings, task_types), "conv_id")
    return consensus_labels(linked.drop("rating").withColumnRenamed("calibrated", "rating"), alpha)


def label_rules(ratings: DataFrame) -> DataFrame:
    """Every item's hard label under each rule: halves of two ratings, ties of others, and the median of two as well.

    Halves go down, up, to the even level, to the most frequent level (`soft`) or to the level that all ratings have more
    often (`prior`); of levels that tie the lowest, the highest or the one that all ratings have most often wins.
    """
    out = _counts(ratings, *ITEM)
    # One row: the shares of levels over all ratings.
    priors = ratings.agg(*(F.avg((F.col("rating") == k).cast("int")).alias(f"q{k}") for k in LEVELS))
    out = out.join(F.broadcast(priors))
    most = F.greatest(*(f"c{k}" for k in LEVELS))
    tied = {k: F.col(f"c{k}") == most for k in LEVELS}
    prior = F.greatest(*(F.when(tied[k], F.col(f"q{k}")) for k in LEVELS))
    top = {
        "lower": F.coalesce(*(F.when(tied[k], k) for k in LEVELS)),
        "upper": F.coalesce(*(F.when(tied[k], k) for k in reversed(LEVELS))),
        "prior": F.coalesce(*(F.when(tied[k] & (F.col(f"q{k}") == prior), k) for k in LEVELS)),
    }
    low = F.floor("mean")
    at = lambda level: F.element_at(F.array(*(F.col(f"q{k}") for k in LEVELS)), level.cast("int"))
    halves = {"down": low, "up": low + 1, "even": low + low % 2, "prior": F.when(at(low) >= at(F.least(low + 1, F.lit(4))), low).otherwise(low + 1)}
    halves |= {f"soft_{mode}": level for mode, level in top.items()}

    def label(half: Column, tie: Column) -> Column:
        two = F.when(F.col("mean") == low, low).otherwise(half)
        return F.when(F.col("n") == 2, two).when(F.col("med") == F.floor("med"), F.col("med")).otherwise(tie).cast("int")

    by_half = [label(half, top["lower"]).alias(f"half_{name}") for name, half in halves.items()]
    by_tie = [label(halves["down"], level).alias(f"tie_{mode}") for mode, level in top.items()]
    median = F.when(F.col("med") == F.floor("med"), F.col("med")).otherwise(top["lower"]).cast("int")
    return out.select(*ITEM, *by_half, *by_tie, median.alias("median_then_soft"))


def pairwise_baselines(ratings: DataFrame, overlap: int = 3) -> DataFrame:
    """Agreement of pairs of raters with enough shared items, averaged over pairs by aspect; pairs without a kappa don't count in its mean."""
    pairs = pair_scores(ratings, "aspect", overlap=overlap)
    return pairs.groupBy("aspect").agg(F.round(F.avg("kappa_present"), 5).alias("qwk"), F.round(F.avg("accuracy"), 5).alias("accuracy"), F.round(F.avg("macro_f1"), 5).alias("macro_f1"), F.round(F.avg("mse"), 5).alias("mse"), F.count("*").alias("n_pairs"))


def against_gold(ratings: DataFrame) -> DataFrame:
    """Each rater against gold by aspect: the other raters' label (`LOO`), and the label of all (`biased`).

    Errors are those to gold's mean, the other scores those to its hard label; kappa is over the levels that occur.
    """
    item = Window.partitionBy(*ITEM)
    others = (F.sum("rating").over(item) - F.col("rating")) / F.nullif(F.count("*").over(item) - 1, F.lit(0))
    loo = ratings.select(*ITEM, "rater_id", others.alias("mean")).join(others_label(ratings), [*ITEM, "rater_id"])
    all_ = consensus_labels(ratings, 0.0).select(*ITEM, F.col("y_hard").alias("label"))
    mean = ratings.select(*ITEM, "rater_id", "rating", F.avg("rating").over(item).alias("mean"))
    biased = mean.join(all_, list(ITEM))
    rows = loo.withColumn("variant", F.lit("LOO")).unionByName(biased.withColumn("variant", F.lit("biased")))
    key = ["variant", "aspect", "rater_id"]
    error = F.col("rating") - F.col("mean")
    soft = rows.groupBy(*key).agg(F.round(F.avg(error * error), 6).alias("mse"), F.round(F.avg(F.abs(error)), 6).alias("mae"))
    hard = scores(rows.select(*key, F.col("label").alias("x"), F.col("rating").alias("y")), *key)
    return soft.join(hard.select(*key, "macro_f1", F.col("kappa_present").alias("qwk"), "accuracy", F.col("n").alias("n_items")), key)


def rater_confusion(ratings: DataFrame) -> DataFrame:
    """How often a pair of raters gave two levels to one item, by aspect; the raters (0, 0) are all pairs, counted both ways."""
    pairs = rater_pairs(ratings).select("aspect", "ra", "rb", "x", "y")
    pooled = pairs.select("aspect", F.lit(0).alias("ra"), F.lit(0).alias("rb"), F.inline(F.array(F.struct("x", "y"), F.struct(F.col("y").alias("x"), F.col("x").alias("y")))))
    return pairs.unionByName(pooled).groupBy("aspect", "ra", "rb", "x", "y").agg(F.count("*").alias("n"))


def named_raters(ratings: DataFrame, truth: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """Ratings by raters' names, with the truth (a `vote` an item) as rater `reference` and a model's levels as `model`.

    Both count only on items that people rated; the largest of several levels of an item counts.
    """
    out = ratings.select(*ITEM, F.concat(F.lit("rater "), F.col("rater_id").cast("string")).alias("rater_id"), "rating")
    seen = ratings.select(*ITEM).distinct()
    for name, levels, column in (("reference", truth, "vote"), ("model", model, "rating")):
        if levels is not None:
            own = levels.groupBy(*ITEM).agg(F.max(column).cast("int").alias("rating")).where("rating is not null")
            out = out.unionByName(own.join(seen, list(ITEM), "left_semi").withColumn("rater_id", F.lit(name)).select(*ITEM, "rater_id", "rating"))
    return out


def full_report(ratings: DataFrame, truth: DataFrame | None = None, model: DataFrame | None = None) -> DataFrame:
    """(aspect, ra, rb, kappa, accuracy, n, alpha): each pair of raters, truth and model among them, and the aspect's ordinal alpha over all of them."""
    rows = named_raters(ratings, truth, model)
    pairs = scores(rater_pairs(rows), "aspect", "ra", "rb").select("aspect", "ra", "rb", F.col("kappa_present").alias("kappa"), "accuracy", "n")
    # A row an aspect.
    return pairs.join(F.broadcast(alpha(rows, "aspect").select("aspect", F.col("alpha_ordinal").alias("alpha"))), "aspect", "left")


def against_reference(ratings: DataFrame, truth: DataFrame) -> DataFrame:
    """(aspect, rater_id, x, y, n, row_share, column_share, share): levels of the truth against those of each rater, and of all (`all`)."""
    rows = named_raters(ratings).join(truth.select(*ITEM, "vote"), list(ITEM))
    both = rows.select("aspect", F.explode(F.array("rater_id", F.lit("all"))).alias("rater_id"), F.col("vote").alias("x"), F.col("rating").alias("y"))
    return crosstab(both, "aspect", "rater_id")
