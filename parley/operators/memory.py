"""The claim memory: checks of proposed updates and the state that they lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The vocabulary of actions and relations, the action that a relation to the same speaker's claim calls
# for, and the patterns of claims that read badly alone.
ACTIONS = ("ADD", "UPDATE", "NONE")
EXPECTED = {"equivalent": "NONE", "forward_entail": "UPDATE", "backward_entail": "NONE", "contradiction": "UPDATE", "neutral": "ADD"}
PRONOUNS = r"(?i)\b(he|she|they|them|his|her|their|it|its|this|that|these|those)\b"
HEDGES = r"(?i)\b(maybe|perhaps|sort of|kind of|i think|i guess|probably|likely)\b"
SEVERAL = r"(?i)\b(and|but|or|;)\b"


def quality_flags(claim: Column) -> list[Column]:
    """Whether a claim has unresolved pronouns, hedges, or several propositions; false for null."""
    return [F.coalesce(claim.rlike(p), F.lit(False)).alias(n) for n, p in (("has_pronoun", PRONOUNS), ("has_hedge", HEDGES), ("has_several", SEVERAL))]


def expected_action(relation: Column, same_speaker: Column) -> Column:
    """The action an update should have: ADD across speakers, else what the relation calls for; null for an unknown relation."""
    by_relation = F.coalesce(*(F.when(relation == r, a) for r, a in EXPECTED.items()))
    return F.when(~same_speaker, F.lit("ADD")).otherwise(by_relation)


def repair(updates: DataFrame) -> DataFrame:
    """Updates (conv_id, pos, speaker, target_speaker, relation, action) with what is wrong and the repaired action.

    Updates without a target keep their action if it is in the vocabulary and become ADD otherwise.
    """
    known = F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))
    wanted = expected_action(F.col("relation"), F.col("speaker") == F.col("target_speaker"))
    fixed = F.coalesce(F.when(F.col("target_speaker").isNotNull(), wanted), F.when(known, F.col("action")), F.lit("ADD"))
    wrong = F.array_compact(F.array(F.when(~known, F.lit("action")), F.when(~F.coalesce(F.col("relation").isin(*EXPECTED), F.lit(False)), F.lit("relation")), F.when(~F.col("action").eqNullSafe(fixed), F.lit("mismatch"))))
    return updates.select("conv_id", "pos", "action", fixed.alias("repaired"), F.array_join(wrong, ",").alias("problems"))


def replay(actions: DataFrame) -> DataFrame:
    """The memories left after all actions (conv_id, pos, action, target, claim) in order of place.

    ADD makes a memory named by its place; UPDATE writes over the target if an earlier ADD made it; NONE does nothing.
    The last write of a memory stands, so the state is one aggregation with partial results, not an ordered fold.
    """
    writes = actions.where(F.col("action").isin("ADD", "UPDATE")).select("conv_id", F.when(F.col("action") == "ADD", F.col("pos")).otherwise(F.col("target")).alias("memory_id"), "pos", "claim", (F.col("action") == "ADD").alias("made"))
    state = writes.groupBy("conv_id", "memory_id").agg(
        F.max_by("claim", F.when(F.col("pos") >= F.col("memory_id"), F.col("pos"))).alias("claim"),
        F.max("pos").alias("written_at"),
        F.count_if(F.col("pos") > F.col("memory_id")).alias("n_updates"),
        F.max("made").alias("exists"),
    )
    return state.where("exists").drop("exists")
