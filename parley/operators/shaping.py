"""Shaping of tables: names, ranges, label release frames, counts over raters and participants, stored lists, times."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.scalars import marked_number
from parley.operators.metrics import t_probabilities

# What an aspect is called, by its release name.
ASPECT_NAMES = {
    "Scope": ("scope", "implication_scope", "implication scope", "imsc"),
    "CIG": ("informativeness", "info", "cig"),
    "Novelty": ("novelty", "novo"),
    "Relevance": ("relevance", "relv"),
}


def aspect_name(name: Column) -> Column:
    """The release's name of an aspect; one that it does not know stays, trimmed."""
    plain = F.trim(name)
    return F.coalesce(*(F.when(F.lower(plain).isin(*known), F.lit(release)) for release, known in ASPECT_NAMES.items()), plain)


def checked_levels(ratings: DataFrame, column: str = "rating") -> DataFrame:
    """The rows, levels as whole numbers: one that is no number goes, one outside 1 to 4 fails the query."""
    level = F.col(column).try_cast("int")
    fine = F.when(level.between(1, 4), level).otherwise(F.raise_error(F.concat(F.lit("a rating outside 1 to 4: "), level.cast("string"))).cast("int"))
    return ratings.where(level.isNotNull()).withColumn(column, fine)


def unit_flag(value: Column) -> Column:
    """A flag as a number from 0 to 1; what is no number is 0."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(value.try_cast("double"), F.lit(0.0))))


def of_corpora(df: DataFrame, column: str, wanted: DataFrame, *without: str) -> DataFrame:
    """Rows whose corpus is wanted (an empty list wants none), without some columns."""
    return df.join(wanted.select(column).distinct(), column, "left_semi").drop(*without)


def preferred_first(df: DataFrame, *columns: str) -> DataFrame:
    """The columns named first, as far as there are any, then the others in their order."""
    return df.select(*(c for c in columns if c in df.columns), *(c for c in df.columns if c not in columns))


def long_sessions(df: DataFrame, key: str, more_than: int = 100) -> DataFrame:
    """Rows of sessions with more than so many; sessions are counted and joined, so that none is one task's window."""
    sizes = df.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") > more_than)
    return df.join(sizes.select(key), key, "left_semi")


def renumbered(utterances: DataFrame) -> DataFrame:
    """Utterances with text, numbered anew from 0 in each conversation."""
    row = F.row_number().over(Window.partitionBy("conv_id").orderBy("idx")) - 1
    return utterances.where(F.trim("text") != "").select("conv_id", "idx", row.alias("number"))


def task_contexts(tasks: DataFrame) -> DataFrame:
    """(corpus, conv_id, segment_id, task_id, utterance_id, utterance_index, speaker, text): a row for every target utterance of a task.

    A task without a corpus has that before the first underscore of its conversation. An utterance that a task names twice
    counts once, by its least index; a task without utterances gives no rows.
    """
    corpus = F.coalesce(F.nullif("corpus_id", F.lit("")), F.substring_index(F.coalesce("conv_id", F.lit("")), "_", 1))
    rows = tasks.select(corpus.alias("corpus"), "conv_id", "segment_id", "task_id", F.explode("utterances").alias("u"))
    first = F.min(F.struct("u.index", "u.speaker", "u.text")).alias("u")
    return rows.groupBy("corpus", "conv_id", "segment_id", "task_id", F.col("u.id").cast("string").alias("utterance_id")).agg(first).select("corpus", "conv_id", "segment_id", "task_id", "utterance_id", F.col("u.index").alias("utterance_index"), F.col("u.speaker").alias("speaker"), F.col("u.text").alias("text"))


def _looked_up(rows: DataFrame, held: DataFrame, key: str, name: str, spread: Column, frequent: int, counted: DataFrame | None = None) -> DataFrame:
    """The rows with what `held` (key, name) has for their key, else null.

    Rows without a key, or whose key more than `frequent` rows have, are dealt by `spread`, so that they do not all go to one
    task; frequent keys, few by their nature, meet what is held of them by broadcast. `counted` has the same keys, if it is
    cheaper to count.
    """
    often = (rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > frequent) & F.col(key).isNotNull()).select(key)
    few = often.join(held, key, "left").select(key, F.lit(True).alias("often"), F.col(name).alias("few"))
    # Lists of two never equal lists of one.
    id_ = F.col(key).cast("string")
    at = F.when(F.col("often") | F.col(key).isNull(), F.array(F.lit("spread"), spread.cast("string"))).otherwise(F.array(id_))
    met = rows.join(F.broadcast(few), key, "left").withColumn("at", at).join(held.select(F.array(id_).alias("at"), F.col(name).alias("many")), "at", "left")
    return met.withColumn(name, F.coalesce("few", "many")).drop("at", "often", "few", "many")


def annotation_rows(annotations: DataFrame, tasks: DataFrame, aspects: list[str], frequent: int = 100_000) -> DataFrame:
    """A label row for every known aspect that an annotation rates, with the corpus and segment of its task.

    The task is that of `base_task_id`, else of `task_id`; without either the corpus comes from the conversation's name.
    """
    known = tasks.select("task_id", F.struct("corpus_id", "segment_id").alias("task"))
    own = F.xxhash64(*(F.col(c).cast("string") for c in ("conv_id", "task_id", "annotator_id")))
    found = annotations
    for key, name in (("base_task_id", "base"), ("task_id", "own")):
        found = _looked_up(found, known.select(F.col("task_id").alias(key), F.col("task").alias(name)), key, name, own, frequent, annotations)
    found = found.withColumn("task", F.coalesce("base", "own"))
    corpus = F.coalesce(F.nullif("task.corpus_id", F.lit("")), F.substring_index(F.coalesce("conv_id", F.lit("")), "_", 1))
    rows = found.select(corpus.alias("corpus"), "conv_id", F.col("task.segment_id").alias("segment_id"), "task_id", "annotator_id", F.explode("utterances").alias("u"))
    rows = rows.select("corpus", "conv_id", "segment_id", "task_id", F.col("annotator_id").alias("source_id"), F.col("u.id").cast("string").alias("utterance_id"), F.explode("u.labels").alias("aspect", "label_value"))
    return rows.where(F.col("aspect").isin(*aspects)).withColumn("aspect", aspect_name(F.col("aspect"))).withColumn("label_source", F.lit("human_individual"))


def released(individual: DataFrame, consensus: DataFrame, contexts: DataFrame) -> DataFrame:
    """Individual and consensus labels in one table, each with the text of its utterance and its index, as far as known."""
    names = ["corpus", "conv_id", "utterance_id", "aspect", "label_value", "label_source", "source_id", "n_raters"]
    rows = individual.withColumn("n_raters", F.lit(None).cast("long")).select(*names).unionByName(consensus.select(*names))
    text = contexts.groupBy("conv_id", "utterance_id").agg(F.min("utterance_index").alias("utterance_index"), F.min_by("text", "utterance_index").alias("text"))
    return rows.join(text, ["conv_id", "utterance_id"], "left")


def rated_breakdown(ratings: DataFrame, truth: DataFrame) -> DataFrame:
    """By utterance, how many raters it has and the mean of one less their error over the range of the truth's levels."""
    span = truth.agg((F.max("vote") - F.min("vote")).alias("span"))  # one row
    rows = ratings.join(truth, ["conv_id", "utterance_id", "aspect"]).join(F.broadcast(span))
    accuracy = F.avg(1 - F.try_divide(F.abs(F.col("rating") - F.col("vote")), F.col("span")))
    return rows.groupBy("conv_id", "utterance_id").agg(F.count_distinct("rater_id").alias("n_annotators"), F.round(accuracy, 6).alias("adjusted_accuracy"))


def participants(utterances: DataFrame, moderators: tuple[str, ...]) -> DataFrame:
    """How many roles that are no moderator's speak in each conversation."""
    role = F.lower(F.trim("role"))
    return utterances.groupBy("conv_id").agg(F.count_distinct(F.when(~role.isin(*moderators), role)).alias("n_participants"))


def latency_summary(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Mean, sample deviation (0 for a single value) and number of values by key."""
    return rows.where(F.col(value).isNotNull()).groupBy(key).agg(F.round(F.avg(value), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp(value), F.lit(0.0)), 6).alias("std"), F.count("*").alias("n"))


def number_list(text: Column) -> Column:
    """A list of numbers that is stored as text; what is none gives an empty list."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def top_quartile_mean(values: Column) -> Column:
    """Mean of the largest quarter of a list (a value at least), 0 for an empty one."""
    down = F.reverse(F.array_sort(values))
    n = F.greatest(F.lit(1), F.ceil(F.size(values) * 0.25).cast("int"))
    return F.when(F.size(values) == 0, 0.0).otherwise(F.aggregate(F.slice(down, F.lit(1), n), F.lit(0.0), lambda s, x: s + x) / n)


def utc_time(text: Column) -> Column:
    """An ISO time as a timestamp of a session in UTC: `Z` and offsets are read, a naive time is UTC; else null."""
    return F.try_to_timestamp(F.nullif(F.trim(text), F.lit("")))


def numbered_context(utterances: DataFrame, k: int = 3) -> DataFrame:
    """The `k` utterances before each one as lines `index. name: content`; `No Context` before the first."""
    before = F.collect_list(F.concat(F.col("idx").cast("string"), F.lit(". "), "role", F.lit(": "), "text")).over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(-k, -1))
    return utterances.select("conv_id", "idx", F.when(F.size(before) == 0, "No Context").otherwise(F.array_join(before, "\n")).alias("context"))


def without_mark(df: DataFrame, text: str, marks: DataFrame, key: str) -> DataFrame:
    """The rows, their key's mark taken out of the text wherever it stands; a key without a mark keeps its texts."""
    return df.join(marks.select(key, "mark"), key, "left").withColumn(text, F.coalesce(F.replace(F.col(text), F.nullif("mark", F.lit(""))), F.col(text))).drop("mark")


def flag_sequence(turns: DataFrame, sentences: DataFrame, acts: list[str]) -> DataFrame:
    """Moderators' turns, each with whether any of its sentences has each act; a turn without a sentence has none.

    Turns (conv_id, utt) that repeat are one, flagged if any is.
    """
    flags = sentences.groupBy("conv_id", "utt").agg(*(F.max((F.col("act") == a).cast("int")).alias(a) for a in acts))
    own = turns.where("is_mod").select("conv_id", "utt").distinct()
    return own.join(flags, ["conv_id", "utt"], "left").select("conv_id", "utt", *(F.coalesce(a, F.lit(0)).alias(a) for a in acts))


def previous_flags(turns: DataFrame, flags: DataFrame, acts: list[str]) -> DataFrame:
    """Participants' turns with the flags of the last moderator's turn before them and how far back it is; null before the first.

    Both kinds of turns are one sequence, along which the last flags are carried, so that no range join is needed.
    """
    both = turns.where("not is_mod").select("conv_id", "utt", "value", F.lit(None).cast("struct<utt:bigint,acts:array<int>>").alias("m"))
    carried = flags.select("conv_id", "utt", F.lit(None).cast("double").alias("value"), F.struct(F.col("utt").cast("long").alias("utt"), F.array(*acts).cast("array<int>").alias("acts")).alias("m"))
    rows = both.withColumn("own", F.lit(True)).unionByName(carried.withColumn("own", F.lit(False)))
    last = F.last("m", ignorenulls=True).over(Window.partitionBy("conv_id").orderBy("utt", "own").rowsBetween(Window.unboundedPreceding, 0))
    out = rows.withColumn("last", last).where("own")
    return out.select("conv_id", "utt", "value", (F.col("utt") - F.col("last.utt")).alias("prev_distance"), *(F.col("last.acts")[k].alias(f"prev_{a}") for k, a in enumerate(acts)))


def flag_lift(previous: DataFrame, acts: list[str]) -> DataFrame:
    """By act and level (1 after a turn with it, else 0, also before any turn of a moderator), the outcome and its lift.

    mean, sem (standard error), n; lift_overall: over all turns with an outcome; lift_other: over the other level; p: Welch's
    test of the two levels, on level 1 if both have two turns or more; marked: the lift over all, starred if p is below 0.05.
    """
    flag = lambda a: F.greatest(F.lit(0), F.least(F.lit(1), F.coalesce(F.col(f"prev_{a}"), F.lit(0)))).cast("int")
    rows = previous.where("value is not null").select("value", F.inline(F.array(*(F.struct(F.lit(a).alias("act"), flag(a).alias("level")) for a in acts))))
    g = rows.groupBy("act", "level").agg(F.avg("value").alias("mean"), F.sum("value").alias("s"), F.var_samp("value").alias("v"), F.count("*").alias("n"))
    # Two rows an act from here.
    of = Window.partitionBy("act")
    other = lambda c: F.sum(c).over(of) - F.col(c)
    g = g.select("*", F.count("*").over(of).alias("levels"), other("mean").alias("m2"), other("v").alias("v2"), other("n").alias("n2"), (F.sum("s").over(of) / F.sum("n").over(of)).alias("overall"))
    a, b = F.col("v") / F.col("n"), F.try_divide("v2", "n2")
    both = (F.col("level") == 1) & (F.col("levels") == 2) & (F.col("n") >= 2) & (F.col("n2") >= 2)
    t = F.try_divide(F.col("mean") - F.col("m2"), F.sqrt(a + b))
    freedom = F.try_divide(F.pow(a + b, 2), F.try_divide(a * a, F.col("n") - 1) + F.try_divide(b * b, F.col("n2") - 1))
    g = g.withColumn("p", t_probabilities(F.when(both, t), F.when(both, freedom))).withColumn("lift", F.col("mean") - F.col("overall"))
    return g.select("act", "level", F.round("mean", 6).alias("mean"), F.round(F.sqrt("v") / F.sqrt("n"), 6).alias("sem"), "n", F.round("lift", 6).alias("lift_overall"), F.round(F.when(F.col("levels") == 2, F.col("mean") - F.col("m2")), 6).alias("lift_other"), "p", marked_number(F.col("lift"), F.col("p")).alias("marked"))


def peaks(curves: DataFrame, k: int, least: int) -> DataFrame:
    """The `k` features whose mean peaks highest over lags that have `least` rows or more."""
    top = curves.where(F.col("n") >= least).groupBy("act").agg(F.max("mean_value").alias("peak")).orderBy(F.desc("peak"), "act").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("peak"), "act")))


def flatten_answers(answers: DataFrame, aspects: list[str], without: tuple[str, ...], contexts: tuple[str, ...]) -> DataFrame:
    """Levels from stored answers that are one JSON object of aspects or a list of them, an object for each run.

    Models named in `without` and contexts not among `contexts` go; an answer that is neither, an unknown aspect and a null
    level give no row.
    """
    text = F.trim("answer")
    runs = F.when(text.startswith("["), F.from_json(text, "array<map<string,int>>")).when(text.startswith("{"), F.array(F.from_json(text, "map<string,int>")))
    rows = answers.where(~F.col("model").isin(*without) & F.col("context").isin(*contexts)).select("model", "context", "conv_id", "utterance_id", F.posexplode(runs).alias("run", "levels"))
    rows = rows.select("model", "context", "conv_id", "utterance_id", "run", F.explode("levels").alias("aspect", "rating"))
    return rows.where(F.col("aspect").isin(*aspects) & F.col("rating").isNotNull())


def run_means(predictions: DataFrame, model: str, context: str) -> DataFrame:
    """Mean over runs of one model's levels in one context, by item."""
    return predictions.where((F.col("model") == model) & (F.col("context") == context)).groupBy("conv_id", "utterance_id", "aspect").agg(F.round(F.avg("rating"), 6).alias("rating"), F.count("*").alias("n_runs"))


def first_by(df: DataFrame, key: str, order: str, *columns: str) -> DataFrame:
    """The values of each key's first row in an order."""
    return df.groupBy(key).agg(*(F.min_by(c, order).alias(c) for c in columns))


def stacked(df: DataFrame, keep: list[str], groups: dict[str, dict[str, str]], tag: str) -> DataFrame:
    """Groups of columns below one another: `groups` names for each tag the columns that become the common ones."""
    rows = [F.struct(F.lit(t).alias(tag), *(F.col(c).alias(name) for name, c in columns.items())) for t, columns in groups.items()]
    return df.select(*keep, F.inline(F.array(*rows)))


def with_vote(ratings: DataFrame, votes: DataFrame) -> DataFrame:
    """All ratings with the vote of their item, null where it has none."""
    return ratings.join(votes, ["conv_id", "utterance_id", "aspect"], "left")


def vote_confusion(predictions: DataFrame, votes: DataFrame) -> DataFrame:
    """How often a model gave each level to items of each vote, all aspects and runs together."""
    return predictions.join(votes, ["conv_id", "utterance_id", "aspect"]).groupBy("model", "vote", "rating").agg(F.count("*").alias("n"))


def normalised_turns(turns: DataFrame, acts: list[str], roles: tuple[str, ...] = ("mod", "moderator")) -> DataFrame:
    """Turns with a plain role, whether a moderator speaks, the text's length, and acts as 0 or 1: null is 0, and so are a participant's."""
    role = F.lower(F.trim("role"))
    is_mod = F.coalesce(role.isin(*roles), F.lit(False))
    flags = [F.when(is_mod, F.coalesce(F.col(a).cast("double"), F.lit(0.0))).otherwise(0.0).alias(a) for a in acts]
    return turns.select(*(c for c in turns.columns if c not in acts), role.alias("role_norm"), is_mod.cast("int").alias("is_mod"), F.length(F.coalesce("text", F.lit(""))).alias("text_len"), *flags)


def wide_labels(labels: DataFrame, utterances: DataFrame, aspects: list[str], value: str) -> DataFrame:
    """(conv_id, utterance_id, text, one column an aspect): labels beside their utterance's text; those without one go."""
    wide = labels.groupBy("conv_id", "utterance_id").pivot("aspect", aspects).agg(F.max(value))
    return utterances.select("conv_id", F.col("idx").alias("utterance_id"), "text").join(wide, ["conv_id", "utterance_id"])
