"""Validation of proposed memory updates: names brought to the vocabulary, targets looked up, rules repaired or reported."""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from parley.operators.memory import ACTIONS, EXPECTED, quality_flags

# Spellings of actions that pass, and how alike two claims are that count as one.
SPELLINGS = {"AD D": "ADD", "UPD": "UPDATE"}
ALIKE = 0.90
TARGET = ("id", "speaker", "target_speaker", "claim", "turn_id")


def action_name(action: Column) -> Column:
    """The action in the vocabulary's spelling; null for one that is not in it."""
    up = F.upper(F.trim(action))
    return F.coalesce(*(F.when(up == k, v) for k, v in SPELLINGS.items()), F.when(up.isin(*ACTIONS), up))


def relation_name(relation: Column) -> Column:
    """The relation in the vocabulary's spelling; null for one that is not in it."""
    low = F.lower(F.trim(relation))
    return F.when(low.isin(*EXPECTED), low)


def _blank(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit(""))) == ""


def incomplete(target: Column) -> Column:
    """Whether a target lacks one of its five fields."""
    empty = lambda f: F.coalesce(target[f], F.lit("")) == ""
    return empty("id") | empty("speaker") | _blank(target["target_speaker"]) | _blank(target["claim"]) | _blank(target["turn_id"])


def _counts(texts: pd.Series) -> np.ndarray:
    """How often characters occur in each text, by code point modulo 64."""
    distinct, at = np.unique(texts.to_numpy(dtype=object), return_inverse=True)
    return np.array([np.bincount(np.frombuffer(t.encode("utf-32-le"), dtype="<u4") % 64, minlength=64) for t in distinct]).reshape(-1, 64)[at]


@F.pandas_udf(DoubleType())
def similarity(first: pd.Series, second: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters of two texts, in lower case; null where that is surely below `ALIKE`.

    No more characters match than both texts have in common, however they are ordered. That bound is computed for a batch
    at once and leaves few pairs to match.
    """
    first, second = first.str.lower(), second.str.lower()
    a, b = _counts(first), _counts(second)
    whole = np.maximum(1, a.sum(axis=1) + b.sum(axis=1))
    close = 2 * np.minimum(a, b).sum(axis=1) / whole >= ALIKE - 1e-9
    return pd.Series([SequenceMatcher(None, x, y).ratio() if c else None for x, y, c in zip(first, second, close, strict=True)], dtype="float64")


def _size_class(text: Column) -> Column:
    """Classes of lengths: two texts that are `ALIKE` are in one class or in neighbouring ones.

    Matched characters are as many as the shorter text's at most, so that the lengths' ratio is (2 - 0.9) / 0.9 at most,
    which is below exp(0.21).
    """
    return F.floor(F.ln(F.greatest(F.length(F.lower(text)), F.lit(1))) / 0.21).cast("int")


def _plain(value: Column) -> Column:
    return F.trim(F.coalesce(value, F.lit("")))


def _held(memories: DataFrame) -> DataFrame:
    """(conv_id, key, by, memory): the memories of conversations by claim and speaker."""
    return memories.where("conv_id is not null").select("conv_id", _plain(F.col("claim")).alias("key"), F.col("speaker").alias("by"), F.struct(*TARGET).alias("memory"))


def _find(both: DataFrame, memories: DataFrame, parts: int | None) -> DataFrame:
    """Rows of `both` that are no memories, with (found, step) by their key and speaker `by`; those without a key find nothing.

    `both` has (conv_id, key, by, memory) of `_held` beside the rows. All that is looked up are windows over groups of a
    conversation, which need no join and, where its rows lie together, no shuffle.
    """
    over = lambda value, *keys: value.over(Window.partitionBy("conv_id", *keys))
    one = lambda *keys: F.when(over(F.count("memory"), *keys) == 1, over(F.min("memory"), *keys))
    both = both.withColumn("low", F.lower("key")).withColumn("own", one("key", "by")).withColumn("any", one("key"))
    # Of memories with one claim the least id stands for all.
    looked = both.withColumn("same", over(F.min_by("memory", "memory.id"), "low")).where("memory is null").drop("memory")
    claims = looked.where((F.col("key") != "") & F.col("same").isNull()).select("conv_id", "low").distinct()
    held = _held(memories).select("conv_id", F.lower("key").alias("other"), "memory").groupBy("conv_id", "other").agg(F.min_by("memory", "memory.id").alias("memory"))
    sized = claims.select("conv_id", "low", F.explode(F.array(*(_size_class(F.col("low")) + d for d in (-1, 0, 1)))).alias("size"))
    near = sized.join(held.withColumn("size", _size_class(F.col("other"))), ["conv_id", "size"])
    near = near.select("conv_id", "low", "memory", similarity("low", "other").alias("alike")).where(F.col("alike") >= ALIKE)
    nearest = near.groupBy("conv_id", "low").agg(F.min_by("memory", F.struct(-F.col("alike"), "memory.id")).alias("near"))
    nearest = nearest.repartition(parts, "conv_id") if parts else nearest
    met = looked.withColumn("asked", F.lit(True)).unionByName(nearest, allowMissingColumns=True)
    met = met.withColumn("near", over(F.min("near"), "low")).where("asked").drop("asked")
    found = F.coalesce("own", "any", F.when(F.col("key") != "", F.coalesce("same", "near")))
    step = F.when(F.col("own").isNotNull(), "speaker").when(F.col("any").isNotNull(), "claim").otherwise("likeness")
    return met.withColumn("found", found).withColumn("step", F.when(F.col("found").isNotNull(), step)).drop("low", "own", "any", "same", "near")


def resolve_targets(wanted: DataFrame, memories: DataFrame, parts: int | None = None) -> DataFrame:
    """(conv_id, pos, found, step): the memory that an update without a good target means, by its own claim.

    `wanted` has (conv_id, pos, speaker, claim), `memories` (conv_id, id, speaker, target_speaker, claim, turn_id). First the
    one memory of that speaker and claim, then the one memory of that claim, then the most alike claim from `ALIKE` on, the
    least id of ties; a claim that several memories share is found there, by equality. Of the other claims each distinct one
    meets each distinct one of like length in its conversation. Claims are compared without blanks around them, a null
    claim is an empty one; an empty one is never looked up by likeness. Where both tables are dealt by conv_id to `parts`
    partitions, they stay there.
    """
    w = wanted.select("conv_id", "pos", F.nullif("speaker", F.lit("")).alias("by"), _plain(F.col("claim")).alias("key"))
    found = _find(w.unionByName(_held(memories), allowMissingColumns=True), memories, parts)
    return found.where(F.col("found").isNotNull()).select("conv_id", "pos", "found", "step")


def validate(updates: DataFrame, memories: DataFrame, fix: bool = True, parts: int | None = None) -> DataFrame:
    """(conv_id, pos, action, relation, source, target, errors, warnings, kept) of each update.

    `updates` has (conv_id, pos, action, relation, source, target), `source` a struct (speaker, target_speaker, claim, turn_id),
    `target` one of (id, speaker, target_speaker, claim, turn_id) or null; an id of a memory occurs once in its conversation.
    With `fix`, spellings, targets and actions are repaired and only what cannot be is an error; of updates of one target by one
    speaker, and then of all with one source, the first is kept. Without it every breach is an error and all are kept,
    a second update of one source being an error of its own. Where both tables are dealt by conv_id to `parts` partitions,
    they stay there, so that no rule shuffles the updates; elsewise each rule deals them by its own keys.
    """
    known, relation = action_name(F.col("action")), relation_name(F.col("relation"))
    rows = updates.select("*", known.alias("known"), relation.alias("known_relation"))
    used = F.col("known") if fix else F.col("action")
    rows = rows.withColumn("target_id", F.col("target.id")).unionByName(_held(memories).withColumn("target_id", F.col("memory.id")), allowMissingColumns=True)
    rows = rows.withColumn("exists", F.count("memory").over(Window.partitionBy("conv_id", "target_id")) > 0).drop("target_id")
    needed, absent = F.coalesce(used.isin("UPDATE", "NONE"), F.lit(False)), F.col("target").isNull()
    poor = ~absent & incomplete(F.col("target"))
    unknown = ~absent & ~poor & ~F.col("exists")
    rows = rows.withColumn("state", F.when(absent & needed, "missing").when(poor, "incomplete").when(unknown, "unknown"))
    wrong_target = F.col("state").isNotNull()
    action, target = used, F.col("target")
    if fix:
        asks = F.col("memory").isNull() & wrong_target
        rows = rows.withColumn("by", F.when(asks, F.nullif(F.col("source.speaker"), F.lit(""))).otherwise(F.col("by"))).withColumn("key", F.when(asks, _plain(F.col("source.claim"))).otherwise(F.col("key")))
        rows = _find(rows, memories, parts)
        dropped = (F.col("state") == "unknown") & (used == "ADD")
        target = F.when(wrong_target & F.col("found").isNotNull(), F.col("found")).when(~F.coalesce(dropped, F.lit(False)), F.col("target"))
        wrong_target = wrong_target & F.col("found").isNull() & ~F.coalesce(dropped, F.lit(False))
        rows = rows.withColumn("target", target).withColumn("wrong_target", wrong_target)
    else:
        rows = rows.where("memory is null").withColumn("wrong_target", wrong_target)
    speaker, theirs = F.nullif(F.col("source.speaker"), F.lit("")), F.nullif(F.col("target.speaker"), F.lit(""))
    relation = F.col("known_relation") if fix else F.col("relation")
    by_relation = F.coalesce(*(F.when(relation == r, a) for r, a in EXPECTED.items()))
    crossed = F.coalesce((speaker != theirs) & action.isin("UPDATE", "NONE"), F.lit(False))
    mapped = F.coalesce((speaker == theirs) & by_relation.isNotNull() & ~by_relation.eqNullSafe(action), F.lit(False))
    source = F.col("source")
    faults = [
        F.when(F.col("known").isNull(), "action"),
        F.when(F.col("known_relation").isNull(), "relation"),
        F.when(F.coalesce(source["speaker"], F.lit("")) == "", "source speaker"),
        F.when((source["target_speaker"] != "") & _blank(source["target_speaker"]), "source target speaker"),
        F.when(_blank(source["claim"]), "source claim"),
        F.when(_blank(source["turn_id"]), "source turn"),
        F.when(F.col("wrong_target"), F.concat(F.col("state"), F.lit(" target"))),
    ]
    if fix:
        final = F.when(crossed, "ADD").when(mapped, by_relation).otherwise(F.coalesce(F.col("known"), F.col("action")))
        rows = rows.withColumn("errors", F.array_compact(F.array(*faults))).withColumn("final", final)
    else:
        faults += [F.when(crossed, "other speaker"), F.when(mapped, "same speaker")]
        rows = rows.withColumn("errors", F.array_compact(F.array(*faults))).withColumn("final", F.col("action"))
    warnings = F.array_compact(F.array(*(F.when(flag, name) for flag, name in zip(quality_flags(source["claim"]), ("pronoun", "hedge", "several"), strict=True))))
    claim_key = [F.col("conv_id"), *(F.coalesce(source[f], F.lit("")).alias(f) for f in ("speaker",)), source["claim"], source["turn_id"]]
    merged = F.when((F.col("final") == "UPDATE") & F.col("target").isNotNull(), F.row_number().over(Window.partitionBy("conv_id", speaker, F.col("target.id"), F.col("final") == "UPDATE", F.col("target").isNull()).orderBy("pos")))
    rows = rows.withColumn("warnings", warnings).withColumn("merged", (F.coalesce(merged, F.lit(1)) > 1) if fix else F.lit(False))
    again = F.row_number().over(Window.partitionBy(*claim_key, "merged").orderBy("pos")) > 1
    rows = rows.withColumn("again", ~F.col("merged") & again)
    out_relation = F.coalesce(F.col("known_relation"), F.col("relation")) if fix else F.col("relation")
    errors = F.col("errors") if fix else F.concat("errors", F.when(F.col("again"), F.array(F.lit("second update"))).otherwise(F.array().cast("array<string>")))
    return rows.select("conv_id", "pos", F.col("final").alias("action"), out_relation.alias("relation"), "source", "target", errors.alias("errors"), "warnings", (~F.col("merged") & ~F.col("again") if fix else F.lit(True)).alias("kept"))


def without_update(claims: DataFrame, validated: DataFrame) -> DataFrame:
    """New claims (conv_id, speaker, claim, turn_id) that no kept update has as its source; a null is a value of its own."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    sources = validated.where("kept").select("conv_id", "source.speaker", "source.claim", "source.turn_id").select("conv_id", *(text(c).alias(f"k_{c}") for c in ("speaker", "claim", "turn_id"))).distinct()
    keyed = claims.select("*", *(text(c).alias(f"k_{c}") for c in ("speaker", "claim", "turn_id")))
    keys = ["conv_id", "k_speaker", "k_claim", "k_turn_id"]
    return keyed.join(sources, keys, "left_anti").drop(*keys[1:])


def summary(validated: DataFrame, memories: DataFrame, claims: DataFrame) -> DataFrame:
    """By conversation, how many memories, new claims, kept updates, errors and warnings, and whether there is no error."""
    sizes = lambda df, name: df.groupBy("conv_id").agg(F.count("*").alias(name))
    own = validated.groupBy("conv_id").agg(F.count_if("kept").alias("n_updates"), F.sum(F.size("errors")).alias("n_errors"), F.sum(F.size("warnings")).alias("n_warnings"))
    out = own.join(sizes(memories, "n_existing"), "conv_id", "full").join(sizes(claims, "n_new_claims"), "conv_id", "full").na.fill(0)
    return out.withColumn("ok", F.col("n_errors") == 0)
