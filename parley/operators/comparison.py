"""Comparison of models: means over runs, ranks, orders, soft scores, ground truth by span, coverage."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.consensus import consensus_labels, majority
from parley.operators.evaluation import ITEM, mae_by_context, truth
from parley.operators.metrics import scores


def _voted(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    return predictions.join(majority(ratings), ITEM).select("model", "context", "run", "aspect", F.col("vote").alias("x"), F.col("rating").alias("y"))


def method_means(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Mean over runs of squared error and kappa by aspect and method (model and context), to three places."""
    runs = scores(_voted(predictions, ratings), "model", "context", "run", "aspect")
    return runs.groupBy("aspect", F.concat_ws("/", "model", "context").alias("method")).agg(F.round(F.avg("mse"), 3).alias("mse"), F.round(F.avg("kappa_fixed"), 3).alias("kappa"))


def aspect_ranks(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ranks of methods within an aspect, by error upwards and kappa downwards; of ties each has the smallest rank."""
    of = Window.partitionBy("aspect")
    out = method_means(predictions, ratings).select("*", F.rank().over(of.orderBy("mse")).alias("rank_mse"), F.rank().over(of.orderBy(F.desc("kappa"))).alias("rank_kappa"))
    return out.withColumn("rank_combined", (F.col("rank_mse") + F.col("rank_kappa")) / 2)


def overall_ranks(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Ranks of methods by the mean of their ranks over aspects; the table has a row for each method."""
    names = ("rank_mse", "rank_kappa", "rank_combined")
    means = aspect_ranks(predictions, ratings).groupBy("method").agg(*(F.round(F.avg(c), 6).alias(c) for c in names))
    return means.select("method", *(F.rank().over(Window.orderBy(c)).alias(c) for c in names))


def model_order(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Models and contexts by kappa downwards, then error, accuracy downwards and squared error."""
    each = scores(_voted(predictions, ratings), "model", "context").select("model", "context", F.col("kappa_fixed").alias("kappa"), "mae", "accuracy", "mse")
    return each.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("kappa"), "mae", F.desc("accuracy"), "mse", "model", "context")))


def models_by_aspect(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Models and contexts within each aspect, in the order of `model_order`."""
    each = scores(_voted(predictions, ratings), "aspect", "model", "context").select("aspect", "model", "context", F.col("kappa_fixed").alias("kappa"), "mae", "accuracy", "mse", "n")
    return each.withColumn("rank", F.row_number().over(Window.partitionBy("aspect").orderBy(F.desc("kappa"), "mae", F.desc("accuracy"), "mse", "model", "context")))


def listed_order(predictions: DataFrame, ratings: DataFrame, models: list[str]) -> DataFrame:
    """Errors in the order of a list of models, those not in it last, then by context and aspect."""
    place = F.coalesce(F.nullif(F.array_position(F.array(*map(F.lit, models)), F.col("model")), F.lit(0)), F.lit(len(models) + 1))
    return mae_by_context(predictions, ratings).select("model", "context", "aspect", "mae", F.row_number().over(Window.orderBy(place, "context", "aspect")).alias("position"))


def soft_scores(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """Errors against items' mean rating: mean absolute, root mean squared, and absolute over the range of the means."""
    rows = predictions.join(truth(ratings), ITEM)
    error = F.col("rating") - F.col("y")
    mae = F.avg(F.abs(error))
    return rows.groupBy("model", "context").agg(F.round(mae, 6).alias("mae"), F.round(F.sqrt(F.avg(error * error)), 6).alias("rmse"), F.round(mae / F.nullif(F.max("y") - F.min("y"), F.lit(0.0)), 6).alias("normalised_mae"), F.count("*").alias("n"))


def truth_by_span(ratings: DataFrame, turns: int = 10) -> DataFrame:
    """Soft and hard label of the items that a task's span of utterances holds, both ends in it.

    Tasks are stretches of `turns` utterance numbers of a conversation; spans meet items by conversation.
    """
    spans = ratings.groupBy("conv_id", F.floor(F.col("utterance_id") / turns).alias("span")).agg(F.min("utterance_id").alias("low"), F.max("utterance_id").alias("high"))
    labels = truth(ratings).join(consensus_labels(ratings, 0.0).select(*ITEM, "y_hard"), ITEM)
    held = labels.join(spans, "conv_id").where(F.col("utterance_id").between(F.col("low"), F.col("high")))
    return held.select("span", *ITEM, F.round("y", 6).alias("soft"), F.col("y_hard").alias("hard"))


def checked_coverage(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """The predictions, if every run of every model has a rating above 1 for every rated item; else an error that names the worst runs."""
    worst = coverage_gaps(predictions, ratings).orderBy(F.desc("n_missing"), "model", "context", "run").limit(5).collect()
    if worst:
        raise ValueError("ratings are missing: " + ", ".join(f"{r.n_missing} of {r.model}/{r.context}/{r.run}" for r in worst))
    return predictions


def coverage_gaps(predictions: DataFrame, ratings: DataFrame) -> DataFrame:
    """How many rated items each run of a model lacks a rating above 1 for; runs without a gap are left out.

    Runs and items are counted and the found ones taken off, so that runs never meet items they lack.
    """
    items = ratings.select(*ITEM).distinct()
    run = ["model", "context", "run"]
    found = predictions.where("rating > 1").select(*run, *ITEM).distinct().join(items, ITEM, "left_semi").groupBy(*run).agg(F.count("*").alias("n"))
    total = items.agg(F.count("*").alias("total"))
    gaps = predictions.select(*run).distinct().join(found, run, "left").join(F.broadcast(total))
    return gaps.select(*run, (F.col("total") - F.coalesce("n", F.lit(0))).alias("n_missing")).where("n_missing > 0")


def mae_grid(ratings: DataFrame) -> DataFrame:
    """Error of eight aggregates of an item's ratings under eight combiners of three aspects, against the first aspect's mean."""
    down = F.reverse(F.array_sort(F.collect_list("rating")))
    each = ratings.groupBy(*ITEM).agg(F.count("*").alias("n"), F.median("rating").alias("median"), F.avg("rating").alias("mean"), (F.count("*") / F.sum(1.0 / F.col("rating"))).alias("harmonic"), down.alias("down"))
    head = lambda m: F.aggregate(F.slice("down", F.lit(1), m), F.lit(0.0), lambda s, x: s + x) / F.least(m, F.col("n"))
    share = lambda q: F.ceil(F.col("n") * q).cast("int")
    methods = {"mean": F.col("mean"), "max": F.element_at("down", 1), "min": F.element_at("down", -1), "median": F.col("median"), "harmonic": F.col("harmonic"), "top2": head(F.lit(2)), "top_quarter": head(share(0.25)), "top_half": head(share(0.5))}
    long = each.select(*ITEM, F.inline(F.array(*(F.struct(F.lit(k).alias("method"), v.cast("double").alias("v")) for k, v in methods.items()))))
    grid = long.groupBy("method", "conv_id", "utterance_id").pivot("aspect", ["A", "N", "R"]).agg(F.first("v")).where("A is not null and N is not null and R is not null")
    x = [F.col(c) for c in ("A", "N", "R")]
    ways = {"min": F.least(*x), "max": F.greatest(*x), "mean": sum(x) / 3, "median": sum(x) - F.greatest(*x) - F.least(*x), "geometric": F.exp(sum(F.ln(c) for c in x) / 3), "harmonic": 3 / sum(1 / c for c in x), "power2": F.sqrt(sum(c * c for c in x) / 3), "softmax": sum(c * F.exp(c) for c in x) / sum(F.exp(c) for c in x)}
    y = truth(ratings).where("aspect = 'A'").select("conv_id", "utterance_id", "y")
    cells = grid.join(y, ["conv_id", "utterance_id"]).select("method", "y", F.inline(F.array(*(F.struct(F.lit(k).alias("combiner"), v.alias("value")) for k, v in ways.items()))))
    return cells.groupBy("method", "combiner").agg(F.round(F.avg(F.abs(F.col("value") - F.col("y"))), 5).alias("mae"), F.count("*").alias("n"))


def by_strength(correlations: DataFrame) -> DataFrame:
    """Correlations, the strongest first whatever their sign; the table has a row for each pair of columns."""
    return correlations.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("spearman").desc_nulls_last(), "first", "second")))
