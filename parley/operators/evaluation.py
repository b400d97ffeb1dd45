"""Model ratings against human ones, over runs and contexts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.ranks import correlations

ITEM = ["conv_id", "utterance_id", "aspect"]


def truth(ratings: DataFrame) -> DataFrame:
    return ratings.groupBy(*ITEM).agg(F.avg("rating").alias("y"))


def mae_by_context(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean absolute error by model, context and aspect: mean and population deviation over runs."""
    runs = predictions.join(truth(ratings), ITEM).groupBy("model", "context", "aspect", "run").agg(F.avg(F.abs(F.col("rating") - F.col("y"))).alias("e"), F.count("*").alias("n"))
    return runs.groupBy("model", "context", "aspect").agg(F.round(F.avg("e"), 6).alias("mae"), F.round(F.stddev_pop("e"), 6).alias("mae_sd"), F.count("*").alias("n_runs"), F.floor(F.avg("n")).cast("long").alias("n_samples"))


def best_by_aspect(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Models and contexts in rank order of their error within an aspect."""
    order = Window.partitionBy("aspect").orderBy("mae", "model", "context")
    return mae_by_context(predictions, ratings).select("aspect", "model", "context", "mae", F.row_number().over(order).alias("rank"))


def reference_mae(predictions: DataFrame, context: str = "full") -> DataFrame:
    """Other contexts against the mean over runs of one."""
    ref = predictions.where(F.col("context") == context).groupBy("model", *ITEM).agg(F.avg("rating").alias("y"))
    return predictions.where(F.col("context") != context).join(ref, ["model", *ITEM]).groupBy("model", "context", "aspect").agg(F.round(F.avg(F.abs(F.col("rating") - F.col("y"))), 6).alias("mae"), F.count("*").alias("n"))


def wide(ratings: DataFrame, aspects=("A", "N", "R")) -> DataFrame:
    """Mean rating of each aspect as a column."""
    return ratings.groupBy("conv_id", "utterance_id").pivot("aspect", list(aspects)).agg(F.avg("rating"))


def aspect_pairs(ratings: DataFrame) -> DataFrame:
    """Two aspects' mean ratings of an item as `x` and `y`, for each pair of aspects."""
    pairs = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("A", "N"), ("A", "R"), ("N", "R"))))
    return wide(ratings).select(F.inline(pairs))


def spearman_by(ratings: DataFrame, corpus: Column) -> DataFrame:
    """Rank correlation of each pair of aspects, over all items (`all`) and by corpus, an expression on the conversation."""
    named = wide(ratings).withColumn("corpus", F.explode(F.array(F.lit("all"), corpus.cast("string"))))
    pairs = F.array(*(F.struct(F.lit(a).alias("first"), F.lit(b).alias("second"), F.col(a).alias("x"), F.col(b).alias("y")) for a, b in (("A", "N"), ("A", "R"), ("N", "R"))))
    return correlations(named.select("corpus", F.inline(pairs)), "corpus", "first", "second", least=1).select("corpus", "first", "second", F.col("spearman").alias("rho"), "n")


def spearman(ratings: DataFrame) -> DataFrame:
    """Rank correlation of each pair of aspects over items that have both; null if one is constant."""
    return correlations(aspect_pairs(ratings), "first", "second", least=1).select("first", "second", F.col("spearman").alias("rho"), "n")


def combiner_grid(ratings: DataFrame) -> DataFrame:
    """Eight ways to combine three aspects into one value, each with its error against the first aspect."""
    x = [F.col(c) for c in ("A", "N", "R")]
    full = wide(ratings).where("A is not null and N is not null and R is not null")
    middle = sum(x) - F.greatest(*x) - F.least(*x)
    ways = {"min": F.least(*x), "max": F.greatest(*x), "mean": sum(x) / 3, "median": middle, "geometric": F.exp(sum(F.ln(c) for c in x) / 3), "harmonic": 3 / sum(1 / c for c in x), "power2": F.sqrt(sum(c * c for c in x) / 3), "softmax": sum(c * F.exp(c) for c in x) / sum(F.exp(c) for c in x)}
    long = full.select(F.col("A").alias("y"), *(v.alias(k) for k, v in ways.items())).unpivot(["y"], list(ways), "combiner", "value")
    return long.groupBy("combiner").agg(F.round(F.avg(F.abs(F.col("value") - F.col("y"))), 6).alias("mae"), F.count("*").alias("n"))


def level_distribution(ratings: DataFrame) -> DataFrame:
    """Percent of each level by aspect, levels that never occur included."""
    grid = ratings.select("aspect").distinct().select("aspect", F.explode(F.array(*map(F.lit, (1, 2, 3, 4)))).alias("rating"))
    counts = grid.join(ratings.groupBy("aspect", "rating").agg(F.count("*").alias("n")), ["aspect", "rating"], "left").na.fill(0, ["n"])
    return counts.select("aspect", "rating", "n", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("aspect")), 6).alias("percent"))
