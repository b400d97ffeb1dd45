"""Queries over key phrases and their marks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import phrases
from parley.registry import register
from parley.sources.tables import utterances, with_views

_CANDIDATES = "[A-Z][a-z]+(?: [a-z]+){1,3}"


def _candidates(spark, sf, *keys):
    """A capitalised word with up to three words after it is a candidate."""
    said = utterances(spark, sf).withColumn("segment_id", F.expr("idx div 4"))
    return said.select(*keys, F.explode(F.regexp_extract_all("text", F.lit(_CANDIDATES), 0)).alias("phrase"))


def _shared(spark, sf):
    """(conv_id, segment_id, phrase): key phrases of the segment before that a segment's own share."""
    keys = ["conv_id", "segment_id"]
    found = phrases.key_phrases(_candidates(spark, sf, *keys), keys).groupBy(*keys).agg(F.collect_list("phrase").alias("own"))
    before = found.select("conv_id", (F.col("segment_id") + 1).alias("segment_id"), F.col("own").alias("before"))
    return found.join(before, keys).select(*keys, F.explode(phrases.shared_phrases(F.col("own"), F.col("before"))).alias("phrase"))


def _told(spark, sf):
    """Every segment's utterances, and those of the segment before, which are its context."""
    said = utterances(spark, sf).withColumn("own", F.expr("idx div 4"))
    return said.select("conv_id", F.explode(F.array("own", F.col("own") + 1)).alias("segment_id"), "idx", "text")


def _marked(spark, sf):
    keys = ["conv_id", "segment_id"]
    return phrases.mark_phrases(_told(spark, sf), _shared(spark, sf), keys, [*keys, "idx"]).select(*keys, "idx", "n_marks", F.md5("text").alias("text"))


_in = lambda words: "(" + ", ".join(f"'{w}'" for w in words) + ")"
_numbers = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in phrases.NUMBERS.items()) + "}"
register("key_phrases", lambda s, d: phrases.key_phrases(_candidates(s, d, "conv_id"), ["conv_id"]), with_views(f"""SELECT * FROM (WITH RECURSIVE raw AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '{_CANDIDATES}')) AS p FROM utterances),
    t AS (SELECT conv_id, lower(p) AS base, string_split(lower(p), ' ') AS t FROM raw),
    k AS (SELECT conv_id, base, list_transform(list_filter(CASE WHEN len(t) > 1 AND t[1] IN {_in(phrases.ARTICLES)} THEN t[2:] ELSE t END, lambda w: w NOT IN {_in(w for w in phrases.STOPS if w != 'of')}), lambda w: coalesce({_numbers}[w], w)) AS t FROM t),
    c AS (SELECT DISTINCT conv_id, canon FROM (SELECT conv_id, base, regexp_replace(array_to_string(t, ' '), '([^ ])( of)+$', '\\1') AS canon FROM k) WHERE canon NOT IN ('', 'of') AND base NOT IN {_in(phrases.EMPTY_PHRASES)} AND (length(canon) >= 3 OR upper(canon) = canon)),
    s AS (SELECT conv_id, sig, min({{'n': -length(canon), 'c': canon}}).c AS canon FROM (SELECT *, list_sort(list_distinct(list_filter(string_split(canon, ' '), lambda w: w <> 'of'))) AS sig FROM c) GROUP BY ALL),
    e AS (SELECT a.conv_id, a.sig AS a, b.sig AS b FROM s a JOIN s b USING (conv_id) WHERE len(list_intersect(a.sig, b.sig)) >= 0.66 * (len(a.sig) + len(b.sig) - len(list_intersect(a.sig, b.sig))) - 1e-9),
    r AS (SELECT conv_id, sig AS node, sig AS root FROM s UNION SELECT r.conv_id, e.b, r.root FROM r JOIN e ON e.conv_id = r.conv_id AND e.a = r.node),
    g AS (SELECT DISTINCT conv_id, canon FROM (SELECT conv_id, root, min({{'n': -length(canon), 'c': canon}}).c AS canon FROM (SELECT conv_id, node, min(root) AS root FROM r GROUP BY ALL) JOIN s ON s.conv_id = r.conv_id AND s.sig = node GROUP BY ALL)) SELECT 1)""".replace("SELECT 1)", "SELECT conv_id, canon AS phrase FROM g WHERE NOT EXISTS (SELECT 1 FROM g h WHERE h.conv_id = g.conv_id AND contains(h.canon, g.canon) AND h.canon <> g.canon))").replace("(SELECT conv_id, node, min(root) AS root FROM r GROUP BY ALL) JOIN s ON s.conv_id = r.conv_id AND s.sig = node", "(SELECT q.conv_id, q.root, s.canon FROM (SELECT conv_id, node, min(root) AS root FROM r GROUP BY ALL) q JOIN s ON s.conv_id = q.conv_id AND s.sig = q.node)"), "utterances"))
# Without SQL: tested against a pattern for each phrase and text.
register("marked_phrases", _marked)
