"""Features of utterances that depend on the conversation they stand in."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Reading speed, and roles that no rater is asked about.
WORDS_PER_MINUTE, LEAST_SECONDS = 238.0, 3.0
MODERATORS = ("mod", "moderator", "audience", "host", "unknown")


def terms(utterances: DataFrame) -> DataFrame:
    """(conv_id, idx, term, tf): lower-case runs of a to z, counted by utterance. Everything else derives from this."""
    each = utterances.select("conv_id", "idx", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("term"))
    return each.groupBy("conv_id", "idx", "term").agg(F.count("*").alias("tf"))


def tfidf(utterances: DataFrame, min_df: int = 2, max_df: float = 0.95) -> DataFrame:
    """Mean, sum and largest tf-idf, and mean and median idf over an utterance's terms; idf is by conversation."""
    t = terms(utterances)
    sizes = utterances.groupBy("conv_id").agg(F.count("*").alias("n"))
    df = t.groupBy("conv_id", "term").agg(F.count("*").alias("df")).join(sizes, "conv_id").where((F.col("df") >= min_df) & (F.col("df") <= max_df * F.col("n")))
    idf = df.select("conv_id", "term", (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1).alias("idf"))
    w = t.join(idf, ["conv_id", "term"]).groupBy("conv_id", "idx").agg(*(f(F.col("tf") * F.col("idf")).alias(n) for f, n in ((F.avg, "a"), (F.sum, "s"), (F.max, "m"))), F.avg("idf").alias("i"), F.median("idf").alias("d"))
    out = utterances.select("conv_id", "idx").join(w, ["conv_id", "idx"], "left")
    return out.select("conv_id", "idx", *(F.round(F.coalesce(c, F.lit(0.0)), 6).alias(n) for c, n in (("a", "tfidf_mean"), ("s", "tfidf_sum"), ("m", "tfidf_max"), ("i", "idf_mean"), ("d", "idf_median"))))


def novelty(utterances: DataFrame) -> DataFrame:
    """How many of an utterance's terms are new to its conversation, and how many were seen before and through it."""
    t = terms(utterances)
    first = t.groupBy("conv_id", "term").agg(F.min("idx").alias("idx"))
    new = first.groupBy("conv_id", "idx").agg(F.count("*").alias("novel"))
    size = t.groupBy("conv_id", "idx").agg(F.count("*").alias("distinct_terms"))
    out = utterances.select("conv_id", "idx").join(size, ["conv_id", "idx"], "left").join(new, ["conv_id", "idx"], "left").na.fill(0)
    so_far = F.sum("novel").over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    out = out.withColumn("seen_through", so_far)
    return out.select("conv_id", "idx", "distinct_terms", "novel", (F.col("seen_through") - F.col("novel")).alias("seen_before"), "seen_through", F.round(F.coalesce(F.try_divide(F.col("novel"), F.col("distinct_terms")), F.lit(0.0)), 6).alias("novelty_ratio"))


def context(utterances: DataFrame, k: int | None = 3) -> DataFrame:
    """The `k` utterances before each one (None: all) as lines, oldest first; `No Context` where there are none."""
    if k == 0:
        return utterances.select("conv_id", "idx", F.lit("No Context").alias("context"))
    so_far = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding if k is None else -k, -1)
    before = F.collect_list(F.concat_ws(": ", "role", "text")).over(so_far)
    return utterances.select("conv_id", "idx", F.when(F.size(before) == 0, "No Context").otherwise(F.array_join(before, "\n")).alias("context"))


def prior_history(utterances: DataFrame, budget: int = 300, most: int = 5) -> DataFrame:
    """(conv_id, idx, n_shown, first_shown, seconds): the utterances before each one that its reader is shown.

    From the one just before, back to `most`, as long as reading time is left after an utterance's own is taken off; the
    first is always shown. Reading time is that of what stands between the line's first and second colon: of `role: text`,
    the text up to its first colon.
    """
    words = F.size(F.filter(F.split(F.substring_index("text", ":", 1), r"\s+"), lambda w: w != ""))
    seconds = F.floor(F.greatest(words / F.lit(WORDS_PER_MINUTE) * 60, F.lit(LEAST_SECONDS))).cast("long")
    order = Window.partitionBy("conv_id").orderBy("idx")
    # Newest first, `most` rows at most: each with the time up to and with it.
    before = F.reverse(F.collect_list(F.struct("idx", "seconds")).over(order.rowsBetween(-most, -1)))
    spent = lambda i: F.aggregate(F.slice("before", F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x["seconds"])
    rows = utterances.select("conv_id", "idx", seconds.alias("seconds")).select("conv_id", "idx", before.alias("before"))
    rows = rows.withColumn("fits", F.transform("before", lambda x, i: (i == 0) | (F.lit(budget) - spent(i) > 0)))
    shown = F.coalesce(F.nullif(F.array_position("fits", False), F.lit(0)) - 1, F.size("before").cast("long"))
    rows = rows.withColumn("shown", F.slice("before", F.lit(1), shown.cast("int")))
    return rows.select("conv_id", "idx", F.size("shown").alias("n_shown"), F.try_element_at("shown", F.lit(-1))["idx"].alias("first_shown"), F.aggregate("shown", F.lit(0).cast("long"), lambda s, x: s + x["seconds"]).alias("seconds"))


def skip_flags(utterances: DataFrame, roles: tuple[str, ...] = MODERATORS) -> DataFrame:
    """Whether a rater may skip an utterance, and whether it stands in the skipped run that opens its conversation."""
    n = F.size(F.split("text", " "))
    skip = F.lower(F.trim("role")).isin(*roles) | (n <= 3) | ((n <= 5) & ~F.col("text").rlike("[.!?]$"))
    flagged = utterances.select("conv_id", "idx", n.alias("n_words"), F.coalesce(skip, F.lit(False)).alias("skip"))
    begun = F.max((~F.col("skip")).cast("int")).over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    return flagged.select("*", (begun == 0).alias("leading"))


def reading_time(utterances: DataFrame) -> DataFrame:
    """Whole seconds to read an utterance, three at least."""
    n = F.size(F.filter(F.split("text", r"\s+"), lambda w: w != ""))
    seconds = F.floor(F.greatest(n / F.lit(WORDS_PER_MINUTE) * 60, F.lit(LEAST_SECONDS))).cast("long")
    return utterances.select("conv_id", "idx", seconds.alias("seconds"))


def gini(utterances: DataFrame) -> DataFrame:
    """Gini coefficient of words by role in each conversation, from ranks."""
    words = utterances.groupBy("conv_id", "role").agg(F.sum(F.size(F.split("text", " "))).alias("x"))
    r = words.withColumn("i", F.row_number().over(Window.partitionBy("conv_id").orderBy("x", "role")))
    n, s = F.count("*"), F.sum("x")
    return r.groupBy("conv_id").agg(F.round(F.coalesce(F.try_divide(2.0 * F.sum(F.col("i") * F.col("x")), n * s) - (n + 1) / n, F.lit(0.0)), 6).alias("gini"), s.alias("words"))


def describe(utterances: DataFrame) -> DataFrame:
    """Utterances, speakers and words of conversations: mean and sample deviation over them, in total."""
    each = utterances.groupBy("conv_id").agg(F.count("*").alias("u"), F.count_distinct("role").alias("s"), F.sum(F.size(F.split("text", " "))).alias("w"))
    return each.agg(F.count("*").alias("n_conversations"), *(x for c, n in (("u", "utterances"), ("s", "speakers"), ("w", "words")) for x in (F.round(F.avg(c), 6).alias(f"{n}_mean"), F.round(F.stddev_samp(c), 6).alias(f"{n}_sd"))))


def summary(values: DataFrame, *by: str) -> DataFrame:
    """Mean, sample deviation, least, largest and count of `value` by group."""
    return values.groupBy(*by).agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"), F.min("value").alias("least"), F.max("value").alias("largest"), F.count("value").alias("n"))


def describe_segments(utterances: DataFrame, roles: tuple[str, ...] = MODERATORS) -> DataFrame:
    """By corpus, and over all (`all`): utterances, and means and sample deviations over segments.

    utterances: (corpus, conv_id, segment_id, idx, role, text), a speaker being a role. Over all utterances: how many a segment
    has and its speakers; over those that raters may not skip: words of one, and the Gini coefficient of words by speaker; and
    the shares of utterances and words that may be skipped. A segment without an utterance left has no words and no Gini.
    """
    own = utterances.select("corpus", "conv_id", "segment_id", "idx", "role").join(skip_flags(utterances, roles), ["conv_id", "idx"])
    key = ["corpus", "conv_id", "segment_id"]
    kept = F.when(~F.col("skip"), F.col("n_words"))
    segments = own.groupBy(*key).agg(F.count("*").alias("u"), F.count(kept).alias("kept"), F.count_distinct("role").alias("s"), F.avg(kept).alias("w"), F.avg(F.col("skip").cast("int")).alias("su"), F.try_divide(F.sum(F.when(F.col("skip"), F.col("n_words"))), F.sum("n_words")).alias("sw"), F.sum("n_words").alias("all_words"))
    segments = segments.withColumn("sw", F.when(F.col("all_words") > 0, F.coalesce("sw", F.lit(0.0))))
    speakers = own.where("not skip").groupBy(*key, "role").agg(F.sum("n_words").alias("x")).withColumn("i", F.row_number().over(Window.partitionBy(*key).orderBy("x", "role")))
    n, total = F.count("*"), F.sum("x")
    even = speakers.groupBy(*key).agg(F.coalesce(F.try_divide(2.0 * F.sum(F.col("i") * F.col("x")), n * total) - (n + 1) / n, F.lit(0.0)).alias("g"))
    each = segments.join(even, key, "left").withColumn("corpus", F.explode(F.array("corpus", F.lit("all"))))
    names = {"u": "utterances", "s": "speakers", "w": "words", "g": "gini", "su": "skipped_utterances", "sw": "skipped_words"}
    return each.groupBy("corpus").agg(F.count("*").alias("n_segments"), F.sum("u").alias("n_utterances"), F.sum("kept").alias("n_kept"), *(F.round(f(c), 6).alias(f"{n}_{k}") for c, n in names.items() for f, k in ((F.avg, "mean"), (F.stddev_samp, "sd"))))
