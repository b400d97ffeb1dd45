"""Checks of stored answers, ids and lengths, all of built-in expressions; what cannot be read is not valid."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parley.functions.scalars import strip_fence

# The fields an answer may have, and the prefix that some conversations' ids carry.
ASPECTS = ("informativeness", "novelty", "relevance", "implication_scope")
PREFIX = "insq_"

_yes = lambda c: F.coalesce(c, F.lit(False))


def _once(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of` the value, which is computed once however often `of` names it; lambdas keep Spark from seeing that it recurs."""
    return F.transform(F.array(value), of)[0]


def valid_summary(answer: Column, least: int = 210, most: int = 350) -> Column:
    """Whether an answer is an object whose `summary` has so many words."""
    words = F.array_remove(F.split(F.get_json_object(strip_fence(answer), "$.summary"), r"\s+"), "")
    return _yes(F.size(words).between(least, most))


def _objects(answer: Column) -> Column:
    return F.from_json(strip_fence(answer), "array<map<string,string>>")


def _only(rows: Column, allowed: tuple[str, ...], needed: str) -> Column:
    """Whether a list of objects has any, each with the needed field and none that is not allowed."""
    fine = lambda o: F.array_contains(F.map_keys(o), needed) & (F.size(F.array_except(F.map_keys(o), F.array(*map(F.lit, allowed)))) == 0)
    return (F.size(rows) > 0) & F.forall(rows, lambda o: _yes(fine(o)))


def valid_ratings(answer: Column, first: Column, last: Column) -> Column:
    """Whether an answer lists ratings of utterances whose first and last index are these."""
    ends = lambda places: (F.try_element_at(places, F.lit(1)) == first) & (F.try_element_at(places, F.lit(-1)) == last) & F.forall(places, lambda p: p.isNotNull())
    placed = lambda rows: _once(F.transform(rows, lambda o: o["utterance_index"].try_cast("long")), ends)
    return _yes(_once(_objects(answer), lambda rows: _only(rows, ("utterance_index", "context_type", *ASPECTS), "utterance_index") & placed(rows)))


def valid_claims(answer: Column, expected: Column) -> Column:
    """Whether an answer lists ratings of claims that cover all expected ids."""
    covers = lambda rows: F.size(F.array_except(expected, F.transform(rows, lambda o: o["id"]))) == 0
    return _yes(_once(_objects(answer), lambda rows: _only(rows, ("id", *ASPECTS), "id") & covers(rows)))


def valid_segments(answer: Column, last: Column) -> Column:
    """Whether an answer lists segments of which the last one ends with the last utterance or one before it."""
    rows = F.from_json(answer, "array<struct<utterances_interval:array<long>>>")
    end = F.try_element_at(F.try_element_at(rows, F.lit(-1))["utterances_interval"], F.lit(2))
    return _yes(_once(end, lambda e: e.between(last - 1, last)))


def aliases(conv_id: Column) -> Column:
    """The id with and without its corpus's prefix."""
    return F.when(conv_id.startswith(PREFIX), F.array(conv_id, F.substring(conv_id, F.lit(len(PREFIX) + 1), F.length(conv_id)))).otherwise(F.array(conv_id, F.concat(F.lit(PREFIX), conv_id)))


def id_parts(utterance_id: Column) -> list[Column]:
    """`conv_id`, what stands before the last underscore (nothing without one), and `utt_index`, the number after it."""
    return [F.regexp_extract(utterance_id, r"(?s)^(.*)_", 1).alias("conv_id"), F.element_at(F.split(utterance_id, "_"), -1).try_cast("double").alias("utt_index")]


def rater_name(name: Column) -> Column:
    """A rater's name, trimmed, line breaks and tabs as blanks, in lower case."""
    return F.lower(F.translate(F.regexp_replace(name, r"^\s+|\s+$", ""), "\n\t", "  "))


def length_series(rows: DataFrame) -> Column:
    """The column `length` as a number where there is one, else the characters of the first text column there is."""
    if "length" in rows.columns:
        return F.col("length").try_cast("double")
    found = next((c for c in ("current_text", "text", "utterance") if c in rows.columns), None)
    if found is None:
        raise KeyError("a column length, current_text, text or utterance is needed")
    return F.length(F.coalesce(F.col(found), F.lit(""))).cast("double")
