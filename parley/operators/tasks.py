"""Annotation tasks: what a segment asks of its rater, its quality, what its reader knows, which summary serves best."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.metrics import scores
from parley.operators.text import LEAST_SECONDS, MODERATORS, WORDS_PER_MINUTE, skip_flags

# A rater's seconds and utterances for a task, and the forms of what a reader is told of the dialogue before.
SECONDS, UTTERANCES = 360, 7
IMMEDIATE = "Immediate prior dialogue:\n"
KNOWLEDGE = ("full", "summary", "memory", "short_prior", "no_knowledge")


def _seconds(text: Column) -> Column:
    words = F.size(F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != ""))
    return F.floor(F.greatest(words / F.lit(WORDS_PER_MINUTE) * 60, F.lit(LEAST_SECONDS))).cast("long")


def assemble(utterances: DataFrame, segments: DataFrame, most: int = 5, moderators: tuple[str, ...] = MODERATORS) -> DataFrame:
    """A task for each segment (conv_id, segment_id, start, end, summary) of utterances (conv_id, idx, speaker, role, text).

    `end` is not in the segment, idx counts from 0 without gaps. Utterances to skip go from the segment's head, which moves its start on.
    Columns: n_utterances, n_valid, shares of utterances and words that are skipped (null without utterances), n_participants
    (speakers in no moderator's role), seconds for the utterances, the summary and the history, and their total, and the
    history: the lines before the start, up to `most`, that fit what is left of `SECONDS`; the nearest is always shown.
    """
    # A segment is a conversation to the skip rule, so that its head is that of the segment.
    places = segments.select("conv_id", "segment_id", F.explode(F.when(F.col("end") > F.col("start"), F.sequence("start", F.col("end") - 1))).alias("idx"))
    within = places.join(utterances, ["conv_id", "idx"]).select(F.struct("conv_id", "segment_id").alias("conv_id"), "idx", "speaker", "role", "text")
    flags = skip_flags(within, moderators)
    held = within.join(flags, ["conv_id", "idx"])
    stays = ~F.col("leading")
    n, words = F.count_if(stays), F.sum(F.when(stays, F.col("n_words")))
    tasks = held.groupBy("conv_id").agg(
        n.alias("n_utterances"),
        F.count_if(~F.col("skip")).alias("n_valid"),
        F.round(F.try_divide(F.count_if(stays & F.col("skip")), n), 6).alias("skipped_utterances"),
        F.round(F.try_divide(F.sum(F.when(stays & F.col("skip"), F.col("n_words")).otherwise(0)), words), 6).alias("skipped_tokens"),
        F.count_distinct(F.when(~F.coalesce(F.lower(F.trim("role")).isin(*moderators), F.lit(False)), F.col("speaker"))).alias("n_participants"),
        F.coalesce(F.sum(F.when(stays, _seconds(F.col("text")))), F.lit(0)).alias("utterance_seconds"),
        F.count_if("leading").alias("moved"),
    ).select("conv_id.*", *("n_utterances n_valid skipped_utterances skipped_tokens n_participants utterance_seconds moved".split()))
    tasks = segments.select("conv_id", "segment_id", "start", _seconds(F.col("summary")).alias("summary_seconds")).join(tasks, ["conv_id", "segment_id"], "left").na.fill(0, ["n_utterances", "n_valid", "n_participants", "utterance_seconds", "moved"])
    tasks = tasks.withColumn("start", F.col("start") + F.col("moved")).drop("moved")
    before = tasks.select("conv_id", "segment_id", "start", (F.lit(SECONDS) - F.col("utterance_seconds") - F.col("summary_seconds")).alias("left"), F.explode(F.when(F.col("start") > 0, F.sequence(F.greatest(F.lit(0), F.col("start") - most), F.col("start") - 1))).alias("idx"))
    line = F.concat(F.coalesce("speaker", F.lit("")), F.lit(" ("), F.coalesce("role", F.lit("")), F.lit("): "), F.coalesce("text", F.lit("")))
    lines = before.join(utterances.select("conv_id", "idx", line.alias("line")), ["conv_id", "idx"]).withColumn("seconds", _seconds(F.element_at(F.split("line", ":"), 2)))
    back = Window.partitionBy("conv_id", "segment_id").orderBy(F.desc("idx"))
    shown = lines.select("*", F.row_number().over(back).alias("rank"), F.sum("seconds").over(back).alias("spent")).where("rank = 1 or left - spent > 0")
    history = shown.groupBy("conv_id", "segment_id").agg(F.sum("seconds").alias("history_seconds"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "line"))), lambda x: x["line"]), "<br><br>").alias("history"))
    out = tasks.join(history, ["conv_id", "segment_id"], "left").na.fill(0, ["history_seconds"]).na.fill("", ["history"])
    return out.withColumn("total_seconds", F.col("utterance_seconds") + F.col("summary_seconds") + F.col("history_seconds"))


def quality(tasks: DataFrame, ratings: DataFrame, segment_scores: DataFrame, aspects: list[str]) -> DataFrame:
    """What tasks are ranked by: costs, benefit of the summary, mean and population deviation of the full context's ratings.

    `ratings` is (conv_id, segment_id, aspect, rating), `segment_scores` (conv_id, segment_id, summary_score, no_summary, confidence).
    `overall_std` is the mean of the aspects' deviations, `spread_of_means` the deviation of their means.
    """
    of = lambda f, a: f(F.when(F.col("aspect") == a, F.col("rating")))
    each = ratings.groupBy("conv_id", "segment_id").agg(*(of(f, a).alias(f"{a}_{n}") for a in aspects for f, n in ((F.avg, "mean"), (F.stddev_pop, "std"))))
    mean = lambda n: sum(F.col(f"{a}_{n}") for a in aspects) / len(aspects)
    spread = F.sqrt(sum(F.pow(F.col(f"{a}_mean") - mean("mean"), 2) for a in aspects) / len(aspects))
    names = [f"{a}_{n}" for a in aspects for n in ("mean", "std")]
    each = each.select("conv_id", "segment_id", *(F.round(c, 6).alias(c) for c in names), F.round(mean("mean"), 6).alias("overall_mean"), F.round(mean("std"), 6).alias("overall_std"), F.round(spread, 6).alias("spread_of_means"))
    costs = tasks.select("conv_id", "segment_id", "skipped_tokens", "skipped_utterances", "n_valid", "n_utterances", "n_participants", "total_seconds", F.abs(F.col("total_seconds") - SECONDS).alias("seconds_off"), F.abs(F.col("n_valid") - UTTERANCES).alias("utterances_off"))
    gains = segment_scores.select("conv_id", "segment_id", F.round(F.col("summary_score") - F.col("no_summary"), 6).alias("context_benefit"), "summary_score", "confidence")
    return costs.join(gains, ["conv_id", "segment_id"], "left").join(each, ["conv_id", "segment_id"], "left")


def knowledge(rows: DataFrame, keys: list[str], methods: tuple[str, ...] = KNOWLEDGE) -> DataFrame:
    """(keys, method, knowledge): what a reader is told, from the columns full_prior, summary, memory and immediate_prior; null is empty."""
    known = lambda c: F.coalesce(F.col(c), F.lit(""))
    near = F.concat(F.lit(IMMEDIATE), known("immediate_prior"), F.lit("\n\n"))
    none = F.lit("No other prior knowledge.\n")
    blocks = {
        "full": F.concat(F.lit("Full Prior Dialogue:\n"), known("full_prior"), F.lit("\n\n")),
        "summary": F.concat(F.lit("Prior dialogue summary:\n"), known("summary"), F.lit("\n\n"), near),
        "memory": F.concat(F.lit("Prior dialogue memory:\n"), known("memory"), F.lit("\n\n"), near),
        "short_prior": F.concat(none, near),
        "no_knowledge": F.concat(none, F.lit("No prior dialogue:\n")),
    }
    return rows.select(*keys, F.inline(F.array(*(F.struct(F.lit(m).alias("method"), blocks[m].alias("knowledge")) for m in KNOWLEDGE if m in methods))))


def summary_scores(candidates: DataFrame, reference: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """(keys, variant, score, best): unweighted kappa of each variant's ratings against the reference's, all aspects together.

    Ratings are (keys, idx, aspect, rating), candidates also with `variant`. A variant that rates other utterances than the
    reference has 0, one whose kappa is undefined null. The best score wins, the first in `order` of equal ones.
    """
    pairs = reference.withColumnRenamed("rating", "x").join(candidates.withColumnRenamed("rating", "y"), [*keys, "idx", "aspect"])
    kappa = scores(pairs, *keys, "variant").select(*keys, "variant", F.col("kappa_nominal").alias("kappa"), "n")
    rated = lambda df, by, name: df.groupBy(*by).agg(F.count_distinct("idx").alias(f"{name}_utterances"), F.count("*").alias(f"{name}_ratings"))
    sizes = rated(candidates, [*keys, "variant"], "own").join(rated(reference, keys, "due"), keys)
    whole = (F.col("own_utterances") == F.col("due_utterances")) & (F.col("n") == F.col("due_ratings"))
    out = sizes.join(kappa, [*keys, "variant"], "left").select(*keys, "variant", F.when(F.coalesce(whole, F.lit(False)), F.col("kappa")).otherwise(0.0).alias("score"))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("variant"))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc_nulls_last("score"), place))
    return out.withColumn("best", (rank == 1) & F.col("score").isNotNull())


def segmentation_report(segments: DataFrame) -> DataFrame:
    """By conversation, how many segments (conv_id, start, end, confidence), their mean confidence and their mean length."""
    return segments.groupBy("conv_id").agg(F.count("*").alias("n_segments"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.round(F.avg(F.col("end") - F.col("start")), 6).alias("mean_length"))
