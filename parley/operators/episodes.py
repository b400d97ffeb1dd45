"""Episodes: wide tables made long, stacked under common ids, who speaks in them, what is named in them."""

from __future__ import annotations

import re
import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.functions.checks import rater_name
from parley.operators.numbering import numbered

# Options of whom an utterance is addressed to, before the speakers, and the end of a sentence.
OPTIONS = ("0 (Unknown)", "1 (Self)", "2 (Everyone)", "3 (Audience)")
SENTENCE = r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|!)\s"


def wide_to_long(rows: DataFrame, raters: list[str]) -> DataFrame:
    """(episode, utterance_id, item_id, annotator, label) of a table with a column for each rater, null labels left out.

    Names are cleaned; of columns whose cleaned names are the same the first that rated an item counts.
    """
    cells = F.array(*(F.struct(F.lit(i).alias("at"), rater_name(F.lit(r)).alias("annotator"), F.col(r).alias("label")) for i, r in enumerate(raters)))
    long = rows.select("episode", "utterance_id", F.concat_ws("||", F.col("episode").cast("string"), F.col("utterance_id").cast("string")).alias("item_id"), F.inline(cells)).where(F.col("label").isNotNull())
    return long.groupBy("episode", "utterance_id", "item_id", "annotator").agg(F.min_by("label", "at").alias("label"))


def matrix(long: DataFrame, raters: list[str]) -> DataFrame:
    """Items by raters, labels as numbers; null where a rater has none or it is no number."""
    of = {r: F.max(F.when(F.col("annotator") == r, F.col("label").try_cast("double"))) for r in sorted(raters)}
    return long.groupBy("item_id").agg(*(c.alias(r) for r, c in of.items()))


def stack(rows: DataFrame) -> DataFrame:
    """Utterances (episode, conv_id, utterance_id, ...) with one `conv_id` an episode and utterance ids that are unique.

    The id is one that the episode has (the least), else the most frequent start of its utterance ids up to the last
    underscore (the least of ties), else `epi_001` and so on in order of episode. An utterance id that occurs again has `::` and
    the conversation's id added.
    """
    start = F.when(F.col("utterance_id").contains("_"), F.regexp_extract("utterance_id", r"(?s)^(.*)_", 1))
    counted = rows.groupBy("episode", start.alias("start")).agg(F.count("*").alias("n"), F.min("conv_id").alias("given"))
    known = counted.groupBy("episode").agg(F.min("given").alias("given"), F.min(F.when(F.col("start").isNotNull(), F.struct(-F.col("n"), "start")))["start"].alias("start"))
    known = known.withColumn("conv_id", F.coalesce("given", "start"))
    # A number for each episode that has no other id.
    unnamed = numbered(known.where("conv_id is null").select("episode"), "episode", "at").select("episode", F.format_string("epi_%03d", F.col("at") + 1).alias("number"))
    ids = known.select("episode", "conv_id").join(unnamed, "episode", "left").select("episode", F.coalesce("conv_id", "number").alias("conv_id"))
    again = rows.groupBy("utterance_id").agg(F.count("*").alias("n")).where("n > 1 and utterance_id is not null").select("utterance_id", F.lit(True).alias("again"))
    out = rows.drop("conv_id").join(ids, "episode").join(again, "utterance_id", "left")
    return out.withColumn("utterance_id", F.when(F.col("again"), F.concat_ws("::", "utterance_id", "conv_id")).otherwise(F.col("utterance_id"))).drop("again")


def act_report(turns: DataFrame, corpora: list[str]) -> DataFrame:
    """Turns of the corpora named, in whatever case."""
    return turns.where(F.lower("corpus").isin(*(c.lower() for c in corpora)))


def vote_listing(ratings: DataFrame, truth: DataFrame) -> DataFrame:
    """By item, the true level (null if none) and each rater's vote as `rater: level`, in order of raters."""
    votes = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rater_id", "rating"))), lambda v: F.concat(v["rater_id"].cast("string"), F.lit(": "), v["rating"].cast("string"))), "; ")
    keys = ["conv_id", "utterance_id", "aspect"]
    return ratings.groupBy(*keys).agg(votes.alias("votes")).join(truth.select(*keys, "vote"), keys, "left")


def conversation_meta(utterances: DataFrame) -> DataFrame:
    """By conversation: its moderator (who spoke last in that role), each speaker's first role, and options of whom one addresses.

    Options after the fixed ones are the turns of debaters for, then of those against, by turn; without any the speakers
    in order of their first turn. A conversation is one row, so its turns are one task's list.
    """
    turn = F.struct("idx", "speaker")
    of = lambda *roles: F.array_sort(F.collect_list(F.when(F.col("role").isin(*roles), turn)))
    first = utterances.groupBy("conv_id", "speaker").agg(F.min("idx").alias("idx"), F.min_by("role", "idx").alias("stance"))
    speakers = first.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("idx", "speaker", "stance"))).alias("speakers"))
    sides = utterances.groupBy("conv_id").agg(F.coalesce(F.max_by("speaker", F.when(F.col("role").isin("mod", "moderator"), F.col("idx"))), F.lit("")).alias("moderator"), of("for").alias("pro"), of("against").alias("con"))
    side = lambda c, n: F.transform(c, lambda t: F.concat(t["speaker"], F.lit(f"- {n}")))
    debaters = F.concat(side(F.col("pro"), "for"), side(F.col("con"), "against"))
    named = F.when(F.size(debaters) > 0, debaters).otherwise(F.transform("speakers", lambda s: s["speaker"]))
    options = F.concat(F.array(*map(F.lit, OPTIONS)), F.transform(named, lambda n, i: F.concat((i + len(OPTIONS)).cast("string"), F.lit(" ("), n, F.lit(")"))))
    return sides.join(speakers, "conv_id").select("conv_id", "moderator", F.transform("speakers", lambda s: F.struct(s["speaker"].alias("speaker"), s["stance"].alias("stance"))).alias("speakers"), options.alias("options"))


def entity_features(utterances: DataFrame, entities: DataFrame) -> DataFrame:
    """Entities (conv_id, idx, entity; repeats count) of utterances (conv_id, idx, n_tokens): all, new ones, and shares of new ones.

    The ratio is over an utterance's distinct entities, the density over its tokens; nothing over nothing is 0.
    """
    distinct = entities.groupBy("conv_id", "idx", "entity").agg(F.count("*").alias("n"))
    new = distinct.groupBy("conv_id", "entity").agg(F.min("idx").alias("idx")).groupBy("conv_id", "idx").agg(F.count("*").alias("novel"))
    own = distinct.groupBy("conv_id", "idx").agg(F.sum("n").alias("n_entities"), F.count("*").alias("n_distinct"))
    out = utterances.select("conv_id", "idx", "n_tokens").join(own, ["conv_id", "idx"], "left").join(new, ["conv_id", "idx"], "left").na.fill(0)
    through = F.sum("novel").over(Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0))
    share = lambda c: F.round(F.col("novel") / F.greatest(F.lit(1), F.col(c)), 6)
    return out.withColumn("known_through", through).select("conv_id", "idx", "n_entities", "n_distinct", "novel", (F.col("known_through") - F.col("novel")).alias("known_before"), "known_through", share("n_distinct").alias("novelty_ratio"), share("n_tokens").alias("novelty_density"))


def capital_runs(sentences: DataFrame, least: int, stops: list[str]) -> DataFrame:
    """(conv_id, mark): every start, of `least` words or more, of the runs of capitalised words in sentences (conv_id, at, sentence).

    A run begins at a capitalised word that is no stop word (`The` may begin one). Stop words right after a capitalised
    word and marks without a word belong to it; any other word ends it.
    """
    tokens = sentences.select("conv_id", "at", F.posexplode(F.split("sentence", " ")).alias("place", "token"))
    edges = re.escape(string.punctuation) + "“”"
    word = F.regexp_replace(F.regexp_replace("token", r"^\s+|\s+$", ""), f"^[{edges}]+|[{edges}]+$", "")
    rows = tokens.withColumn("word", word).withColumn("capital", F.col("word").rlike(r"^\p{Lu}"))
    own = Window.partitionBy("conv_id", "at").orderBy("place")
    held = (F.col("word") == "") | F.col("capital") | (F.coalesce(F.lag("capital").over(own), F.lit(False)) & F.col("word").isin(*stops))
    # Words that end runs part a sentence; a run begins at the first word in a part that may begin one.
    rows = rows.withColumn("part", F.sum((~held).cast("int")).over(own))
    part = Window.partitionBy("conv_id", "at", "part")
    begins = F.col("capital") & ((F.col("word") == "The") | ~F.lower("word").isin(*stops))
    rows = rows.withColumn("first", F.min(F.when(begins, F.col("place"))).over(part)).where(F.col("place") >= F.col("first"))
    so_far = part.orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    runs = rows.select("conv_id", F.array_join(F.collect_list("token").over(so_far), " ").alias("mark"), F.sum((F.col("word") != "").cast("int")).over(so_far).alias("words"))
    return runs.where(F.col("words") >= least).select("conv_id", "mark")


def watermarks(utterances: DataFrame, stops: list[str], least: int = 3, times: int = 50) -> DataFrame:
    """(conv_id, mark, n): the run of capitalised words that a conversation's sentences repeat most, n is 0 without any.

    The longest of runs that are equally frequent, then the least; the mark is null below so many `times`. Sentences are cut from the whole text
    of a conversation, one may go on in the next utterance; it is one task's list.
    """
    whole = utterances.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "text"))), lambda u: F.coalesce(u["text"], F.lit(""))), " ").alias("text"))
    sentences = whole.select("conv_id", F.posexplode(F.split("text", SENTENCE)).alias("at", "sentence"))
    counts = capital_runs(sentences, least, stops).groupBy("conv_id", "mark").agg(F.count("*").alias("n"))
    best = counts.groupBy("conv_id").agg(F.min(F.struct(-F.col("n"), -F.length("mark"), "mark")).alias("best"), F.max("n").alias("n"))
    out = utterances.select("conv_id").distinct().join(best, "conv_id", "left")
    return out.select("conv_id", F.when(F.col("n") >= times, F.col("best.mark")).alias("mark"), F.coalesce("n", F.lit(0)).alias("n"))


def capitalised(text: Column) -> Column:
    """Capitalised words, which stand for entities where nothing names them better."""
    return F.regexp_extract_all(text, F.lit(r"\b([A-Z][a-z]+)"), 1)
