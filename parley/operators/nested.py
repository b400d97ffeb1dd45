"""Nested annotation and prediction documents as tidy rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def level(value: Column) -> Column:
    """A rating read leniently: whole numbers 1 to 4 in any notation, else null."""
    number = value.cast("string").try_cast("int")
    return F.when(number.between(1, 4), number)


def first_filled(*columns: Column) -> Column:
    """The first that is neither null nor an empty text."""
    return F.coalesce(*(F.nullif(c, F.lit("")) for c in columns))


def flatten_annotations(docs: DataFrame, aspects: list[str]) -> DataFrame:
    """A row for each label of documents (conv_id, rater_id, utterances: array of (utterance_id, labels: map)).

    Blank raters, unknown aspects and ratings outside 1 to 4 are left out; null lists and maps have no rows.
    """
    said = docs.where(F.trim(F.col("rater_id").cast("string")) != "").select("conv_id", "rater_id", F.inline("utterances"))
    rows = said.select("conv_id", "utterance_id", "rater_id", F.explode("labels").alias("aspect", "value"))
    canonical = F.upper(F.trim("aspect"))
    return rows.where(canonical.isin(*aspects)).select("conv_id", "utterance_id", canonical.alias("aspect"), "rater_id", level(F.col("value")).alias("rating")).where("rating IS NOT NULL")


def flatten_predictions(docs: DataFrame, aspects: list[str]) -> DataFrame:
    """A row for each rating of documents (conv_id, predictions: map model -> map context -> array of (utterance_id, run, one field an aspect)).

    Aspects without a rating have no row.
    """
    models = docs.select("conv_id", F.explode("predictions").alias("model", "contexts"))
    items = models.select("conv_id", "model", F.explode("contexts").alias("context", "items")).select("conv_id", "model", "context", F.inline("items"))
    return items.unpivot(["conv_id", "model", "context", "utterance_id", "run"], aspects, "aspect", "rating").where("rating IS NOT NULL")


def nest_annotations(ratings: DataFrame) -> DataFrame:
    """The inverse of `flatten_annotations`; one document holds one rater's labels of one conversation."""
    labels = F.map_from_entries(F.collect_list(F.struct("aspect", F.col("rating").cast("string"))))
    said = ratings.groupBy("conv_id", "rater_id", "utterance_id").agg(labels.alias("labels"))
    return said.groupBy("conv_id", "rater_id").agg(F.collect_list(F.struct("utterance_id", "labels")).alias("utterances"))


def nest_predictions(predictions: DataFrame, aspects: list[str]) -> DataFrame:
    """The inverse of `flatten_predictions`; one document holds one conversation."""
    item = predictions.groupBy("conv_id", "model", "context", "utterance_id", "run").agg(*(F.max(F.when(F.col("aspect") == a, F.col("rating"))).alias(a) for a in aspects))
    by_context = item.groupBy("conv_id", "model", "context").agg(F.collect_list(F.struct("utterance_id", "run", *aspects)).alias("items"))
    by_model = by_context.groupBy("conv_id", "model").agg(F.map_from_entries(F.collect_list(F.struct("context", "items"))).alias("contexts"))
    return by_model.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("model", "contexts"))).alias("predictions"))


def merge_modes(predictions: DataFrame, aspects: list[str]) -> DataFrame:
    """One row an utterance and model: each aspect from the last mode (context, then run) that rated it, and all contexts."""
    order = F.struct("context", "run")
    rated = [F.max_by("rating", F.when(F.col("aspect") == a, order)).alias(a) for a in aspects]
    return predictions.groupBy("model", "conv_id", "utterance_id").agg(*rated, F.array_join(F.array_sort(F.collect_set("context")), "|").alias("contexts"))
