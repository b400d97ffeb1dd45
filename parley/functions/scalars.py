"""Scalar functions on columns, all of built-in expressions; null gives null."""

from __future__ import annotations

import html
import re
from html.entities import html5

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType


def strip_fence(text: Column) -> Column:
    """What stands between the first code fence, with or without a language, and the next; else the trimmed text."""
    # Found by plain search: a lazy pattern walks the whole text, character by character, twice.
    rest = F.substr(text, F.locate("```", text) + 3)
    inner = F.regexp_extract(F.substring_index(rest, "```", 1), r"(?s)^[a-zA-Z]*\n?(.*)", 1)
    fenced = text.contains("```") & rest.contains("```")
    return F.btrim(F.when(fenced & (inner != ""), inner).otherwise(text), F.lit(" \t\n\x0b\f\r"))


def plain_punctuation(text: Column) -> Column:
    """Curly quotes, long dashes and the ellipsis in ASCII; leading hyphens go."""
    straight = F.translate(text, "‘’“”—–", "''\"\"--")
    return F.regexp_replace(F.replace(straight, F.lit("…"), F.lit("...")), r"^-+", "")


@F.pandas_udf(StringType())
def _unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def _unescape_closed(texts: pd.Series) -> pd.Series:
    one = lambda m: html.unescape(m[0]) if m[1][0] == "#" else html5.get(m[1], m[0])
    return texts.map(lambda t: re.sub(r"&(#\d+;|#[xX][0-9a-fA-F]+;|\w+;)", one, t), na_action="ignore")


def strip_html(text: Column, closed: bool = False) -> Column:
    """Text of markup: scripts, styles and comments vanish, tags become blanks, entities are read, white space collapses.

    As in browsers `&amp` is read too; `closed` reads only entities that end in a semicolon and leaves such remains of cut
    texts. Only texts that hold an ampersand once tags are gone leave the JVM, for it knows no named entities.
    """
    out = F.regexp_replace(text, r"(?is)<(script|style)\b.*?>.*?</\1>", "")
    out = F.regexp_replace(F.regexp_replace(out, r"(?s)<!--.*?-->", ""), r"<[^>]+>", " ")
    out = F.when(out.contains("&"), (_unescape_closed if closed else _unescape)(F.when(out.contains("&"), out))).otherwise(out)
    return F.trim(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))


def last_number(text: Column) -> Column:
    """The last run of digits as a number; null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(r"(\d+)")), F.lit(-1)).try_cast("long")


def jaccard(first: Column, second: Column) -> Column:
    """Common elements over all elements of two arrays; two empty ones are alike."""
    union = F.size(F.array_union(first, second))
    return F.when(union == 0, 1.0).otherwise(F.try_divide(F.size(F.array_intersect(first, second)), union))


def round_half(value: Column, rule: str) -> Column:
    """Rounded to a whole number, halves `down`, `up` or to `even`."""
    whole = F.floor(value)
    half = value - whole == 0.5
    if rule == "even":
        return F.bround(value, 0).cast("long")
    if rule not in ("down", "up"):
        raise ValueError(f"unknown rule for halves: {rule}")
    return F.when(half, whole if rule == "down" else whole + 1).otherwise(F.floor(value + 0.5))


def marked_number(value: Column, p: Column, alpha: float = 0.05) -> Column:
    """A number with three decimals, starred if its probability is below `alpha`."""
    return F.concat(F.format_string("%.3f", value), F.when(p < alpha, "*").otherwise(""))


def distance(first: Column, second: Column) -> Column:
    """Euclidean distance of two arrays of numbers."""
    return F.sqrt(F.aggregate(F.zip_with(first, second, lambda a, b: F.pow(a - b, 2)), F.lit(0.0), lambda s, x: s + x))


def valid_rating(json: Column) -> Column:
    """Whether a text is a JSON object whose `rating` is 1 to 4; false for null."""
    number = F.get_json_object(json, "$.rating").try_cast("int")
    return F.coalesce(number.between(1, 4), F.lit(False))
