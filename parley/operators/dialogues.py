"""Dialogue datasets: every utterance with as much of what was said before as a budget of ids holds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType

#: Ids that stand between the parts of an input.
MARGIN = 2


def line(speaker: Column, role: Column, text: Column) -> Column:
    """An utterance as a line of context (the format is fixed)."""
    return F.concat(speaker, F.lit(" ("), role, F.lit("): "), text, F.lit(" \n"))


def encoder(path: str):
    """A vectorised function from texts to their ids by the tokenizer file at `path`, which every executor can read; null gives none."""

    @F.pandas_udf(ArrayType(LongType()))
    def ids(texts):
        import pandas as pd
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(path).encode_batch([t or "" for t in texts], add_special_tokens=False)
        return pd.Series([e.ids for e in found])

    return ids


def windows(rows: DataFrame, most: int, context: int | None = 10, n_meta: int = 0) -> DataFrame:
    """(conv_id, idx, first_idx, n_context, context_ids, n_ids, start): what of the context fits beside each utterance.

    rows: (conv_id, idx, n_line, n_target, n_text), ids of an utterance's line of context, of it as the target, and of its
    text. Up to `context` utterances (None: all) before one are its context if their ids are at most what `most` leaves; else
    the longest run that ends just before it and has fewer. `start` is where the text's ids begin, counted from the end as if
    nothing followed them; one id opens the input. Idx orders a conversation and is unique in it.

    Sums of ids up to each utterance are searched by one sort: an utterance's bound meets them in order of value, and the last
    sum at or below it tells where its window starts. So a long conversation costs a sort, whatever `context` is.
    """
    of = Window.partitionBy("conv_id")
    order = of.orderBy("idx")
    numbers = rows.select("conv_id", "idx", "n_line", "n_target", "n_text", (F.row_number().over(order) - 1).alias("at"))
    so_far = F.sum("n_line").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n_line")
    numbers = numbers.withColumn("before", so_far).withColumn("quota", F.lit(most - n_meta - MARGIN) - F.col("n_target"))
    least = F.lit(0) if context is None else F.greatest(F.lit(0), F.col("at") - context)
    # The sum at the first place that the context may start from comes from the row that many before.
    earliest = F.lit(0) if context is None else F.coalesce(F.lag("before", context).over(order), F.lit(0)) if context else F.col("before")
    numbers = numbers.withColumn("least", least).withColumn("whole", (F.col("before") - earliest) <= F.col("quota"))
    sums = numbers.select("conv_id", F.col("before").alias("value"), F.lit(0).alias("asks"), "at", F.lit(None).cast("long").alias("idx"))
    bounds = numbers.where(~F.col("whole") & (F.col("quota") > 0)).select("conv_id", (F.col("before") - F.col("quota")).alias("value"), F.lit(1).alias("asks"), F.lit(None).cast("int").alias("at"), "idx")
    last = F.max("at").over(of.orderBy("value", "asks").rowsBetween(Window.unboundedPreceding, 0))
    found = sums.unionByName(bounds).withColumn("last", last).where("asks = 1").select("conv_id", "idx", F.col("last").alias("last"))
    joined = numbers.join(found, ["conv_id", "idx"], "left")
    begin = F.when(F.col("quota") <= 0, F.col("at")).when(F.col("whole"), F.col("least")).otherwise(F.least(F.col("at"), F.greatest(F.col("least"), F.coalesce(F.col("last") + 1, F.lit(0)))))
    joined = joined.withColumn("begin", begin)
    starts = numbers.select("conv_id", F.col("at").alias("begin"), F.col("idx").alias("first_idx"), F.col("before").alias("from_ids"))
    out = joined.join(starts, ["conv_id", "begin"])
    context_ids = F.col("before") - F.col("from_ids")
    total = F.lit(1 + n_meta) + context_ids + F.col("n_target")
    return out.select("conv_id", "idx", F.when(F.col("begin") < F.col("at"), F.col("first_idx")).alias("first_idx"), (F.col("at") - F.col("begin")).cast("long").alias("n_context"), context_ids.cast("long").alias("context_ids"), total.cast("long").alias("n_ids"), (total - F.col("n_text")).cast("long").alias("start"))


def context_texts(utterances: DataFrame, shown: DataFrame) -> DataFrame:
    """(conv_id, idx, context): the lines of each utterance's window, oldest first; utterances: (conv_id, idx, speaker, role, text).

    Each window fetches its own lines, by place, so that work grows with what is shown.
    """
    order = Window.partitionBy("conv_id").orderBy("idx")
    lines = utterances.select("conv_id", "idx", (F.row_number().over(order) - 1).alias("at"), line(F.col("speaker"), F.col("role"), F.col("text")).alias("line"))
    places = lines.select("conv_id", "idx", "at").join(shown.select("conv_id", "idx", "n_context"), ["conv_id", "idx"])
    wanted = places.where("n_context > 0").select("conv_id", F.col("idx").alias("of"), F.explode(F.sequence((F.col("at") - F.col("n_context")).cast("int"), F.col("at") - 1)).alias("at"))
    texts = wanted.join(lines.select("conv_id", "at", "line"), ["conv_id", "at"]).groupBy("conv_id", "of").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), "").alias("context"))
    return utterances.select("conv_id", "idx").join(texts.withColumnRenamed("of", "idx"), ["conv_id", "idx"], "left").select("conv_id", "idx", F.coalesce("context", F.lit("")).alias("context"))


def encoded(utterances: DataFrame, path: str, most: int, opening: int, ending: int, context: int | None = 10) -> DataFrame:
    """(conv_id, idx, input_ids, start): inputs of real ids: the opening id, the window's lines, the target and the ending id.

    Every line is encoded once and by itself; an input is the concatenation of its lines' ids.
    """
    ids = encoder(path)
    own = line(F.col("speaker"), F.col("role"), F.col("text"))
    target = F.concat("speaker", F.lit(" ("), "role", F.lit("): "), "text")
    rows = utterances.select("conv_id", "idx", ids(own).alias("line_ids"), F.concat(ids(target), F.array(F.lit(ending).cast("long"))).alias("target_ids"), F.size(ids("text")).alias("n_text"))
    counts = rows.select("conv_id", "idx", F.size("line_ids").alias("n_line"), F.size("target_ids").alias("n_target"), "n_text")
    shown = windows(counts, most, context)
    order = Window.partitionBy("conv_id").orderBy("idx")
    placed = rows.withColumn("at", F.row_number().over(order) - 1)
    wanted = placed.select("conv_id", "idx", "at").join(shown, ["conv_id", "idx"]).where("n_context > 0").select("conv_id", F.col("idx").alias("of"), F.explode(F.sequence((F.col("at") - F.col("n_context")).cast("int"), F.col("at") - 1)).alias("at"))
    before = wanted.join(placed.select("conv_id", "at", "line_ids"), ["conv_id", "at"]).groupBy("conv_id", F.col("of").alias("idx")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("at", "line_ids"))), lambda x: x["line_ids"])).alias("before"))
    out = rows.join(shown.select("conv_id", "idx", "start"), ["conv_id", "idx"]).join(before, ["conv_id", "idx"], "left")
    none = F.array().cast("array<bigint>")
    return out.select("conv_id", "idx", F.concat(F.array(F.lit(opening).cast("long")), F.coalesce("before", none), "target_ids").alias("input_ids"), "start")
