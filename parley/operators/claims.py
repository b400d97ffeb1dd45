"""Claims of utterances: features from their ratings, changes of memory, and the texts made of memories and turns.

A claim is (conv_id, utterance_id, claim_id, info, novo, relv, imsc, action, relation); ratings are levels 1 to 4.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.operators.memory import ACTIONS

KEY = ["conv_id", "utterance_id"]
SCALES = ("info", "novo", "relv", "imsc")
_LEVELS = (1, 2, 3, 4)
# The relations that rated claims name.
RELATIONS = ("equivalent", "forward entailment", "backward entailment", "contradiction", "neutral")


def _of_counts(c: dict[int, Column]) -> dict[str, Column]:
    """Statistics of a multiset of levels from the count of each; null where there are none."""
    n = sum(c.values())
    upto = {k: sum(c[j] for j in _LEVELS if j <= k) for k in _LEVELS}
    at = lambda place: F.coalesce(*(F.when(upto[k] >= place, k) for k in _LEVELS))

    def top(m: Column) -> Column:
        m = F.least(m, n)
        taken = {k: F.least(c[k], F.greatest(F.lit(0), m - (n - upto[k]))) for k in _LEVELS}
        return F.try_divide(sum(k * taken[k] for k in _LEVELS), m)

    some = lambda value: F.when(n > 0, value)
    share = lambda q: F.greatest(F.lit(1), F.ceil(n * q))
    return {
        "mean": F.try_divide(sum(k * c[k] for k in _LEVELS), n),
        "max": some(at(n)),
        "min": some(at(F.lit(1))),
        "median": some((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2),
        "harmonic": F.try_divide(n, sum(c[k] / k for k in _LEVELS)),
        "top2": some(top(F.lit(2))),
        "top_quarter": some(top(share(0.25))),
        "top_half": some(top(share(0.5))),
    }


def _entropy(counts: list[Column]) -> Column:
    total = sum(counts)
    p = [F.try_divide(c, total) for c in counts]
    return -sum(x * F.log2(x + 1e-12) for x in p)


def claim_features(claims: DataFrame, utterances: DataFrame, fill: float = 1.0) -> DataFrame:
    """A row for each utterance (conv_id, utterance_id, text) with features of its claims.

    One aggregation counts levels, actions and relations with partial results; all statistics follow from these counts,
    so no list of an utterance's claims is gathered. Utterances without claims, and scales without a rating, get `fill`.
    """
    counted = [F.count_if(F.col(s) == k).alias(f"{s}{k}") for s in SCALES for k in _LEVELS]
    acts = {a: F.count_if(F.col("action") == a).alias(f"act_{a}") for a in ACTIONS}
    named = {r: r.replace(" ", "_") for r in RELATIONS}
    relations = {r: F.count_if(F.col("relation") == r).alias(f"rel_{n}") for r, n in named.items()}
    changed = F.count_if(~F.col("action").eqNullSafe(F.lit("NONE"))).alias("n_changes")
    per = claims.groupBy(*KEY).agg(F.count("*").alias("n_claims"), changed, *counted, *acts.values(), *relations.values())
    rows = utterances.select(*KEY, F.coalesce(F.regexp_count("text", F.lit(r"[A-Za-z0-9][A-Za-z0-9'\-]*")), F.lit(0)).alias("n_tokens")).join(per, KEY, "left").na.fill(0)
    n, floor_ = F.col("n_claims"), F.greatest(F.lit(1), F.col("n_tokens"))
    filled = lambda c, name: F.round(F.coalesce(c, F.lit(fill)), 6).alias(name)
    stats = [filled(v, f"{k}_{s}") for s in SCALES for k, v in _of_counts({k: F.col(f"{s}{k}") for k in _LEVELS}).items()]
    shares = [filled(F.try_divide(F.col(c), n), f"share_{c}") for c in [f"act_{a}" for a in ACTIONS] + [f"rel_{n}" for n in named.values()]]
    entropies = [filled(_entropy([F.col(f"{p}_{k}") for k in kinds]), f"{p}_entropy") for p, kinds in (("act", ACTIONS), ("rel", named.values()))]
    return rows.select(*KEY, "n_tokens", "n_claims", "n_changes", F.round(F.coalesce(F.try_divide("n_changes", n), F.lit(0.0)), 6).alias("p_changes"), F.round(n / floor_, 6).alias("claim_density"), F.round(F.col("n_changes") / floor_, 6).alias("change_density"), *stats, *shares, *entropies)


def memory_deltas(claims: DataFrame, utterances: DataFrame, above: int = 2) -> DataFrame:
    """Claims of each utterance, those that changed the memory, and of these the ones rated over `above` by scale and by three at once."""
    change = ~F.col("action").eqNullSafe(F.lit("NONE"))
    high = {s: F.coalesce(F.col(s) > above, F.lit(False)) for s in SCALES}
    gates = {f"delta_{s}": high[s] for s in SCALES} | {"delta_triad": high["novo"] & high["relv"] & high["imsc"]}
    per = claims.groupBy(*KEY).agg(F.count("*").alias("claim_count"), F.count_if(change).alias("mem_delta"), *(F.count_if(change & g).alias(k) for k, g in gates.items()))
    return utterances.select(*KEY).join(per.withColumn("used", F.lit(True)), KEY, "left").na.fill(0).na.fill(False, ["used"])


def join_actions(rated: DataFrame, actions: DataFrame) -> DataFrame:
    """Rated claims (conv_id, utterance_id, claims: array) with the action that nested actions (…, actions: array) give their id; null where none does."""
    claims = rated.select(*KEY, F.inline("claims"))
    return claims.join(actions.select(*KEY, F.inline("actions")), [*KEY, "claim_id"], "left")


def memory_lines(memories: DataFrame, cutpoint: int = -1) -> DataFrame:
    """One text a conversation: a line for each memory (conv_id, turn_id, speaker, claim) by turn, those whose turn is no number last.

    A positive `cutpoint` leaves out later turns, and turns that are no number. Missing speakers are "Unknown".
    """
    turn = F.col("turn_id").cast("string").try_cast("long")
    line = F.concat(F.lit("- (Turn #"), F.coalesce(F.col("turn_id").cast("string"), F.lit("-1")), F.lit(") "), F.coalesce("speaker", F.lit("Unknown")), F.lit(': "'), F.coalesce("claim", F.lit("")), F.lit('"\n'))
    kept = memories.select("conv_id", turn.isNull().alias("odd"), turn.alias("turn"), line.alias("line")).where(F.lit(cutpoint <= 0) | (F.col("turn") <= cutpoint))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("odd", "turn", "line"))), lambda m: m["line"])
    return kept.groupBy("conv_id").agg(F.array_join(lines, "").alias("memories"))


def transcript(utterances: DataFrame) -> DataFrame:
    """One text a conversation: numbered lines `i. speaker (role): text`, a blank line between them."""
    line = F.concat(F.col("idx").cast("string"), F.lit(". "), F.coalesce("speaker", F.lit("")), F.lit(" ("), F.coalesce("role", F.lit("")), F.lit("): "), F.coalesce("text", F.lit("")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("idx", line.alias("line")))), lambda m: m["line"])
    return utterances.groupBy("conv_id").agg(F.array_join(lines, "\n\n").alias("transcript"))


def known_at(segments: DataFrame, memories: DataFrame) -> DataFrame:
    """The memories (conv_id, turn_id, …) that stand when each segment (conv_id, segment, start) begins: those of earlier turns."""
    rows = segments.select("conv_id", "segment", "start").join(memories, "conv_id")
    return rows.where(F.col("turn_id") < F.col("start")).drop("start")
