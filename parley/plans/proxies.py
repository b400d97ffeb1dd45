"""Queries over dialogue datasets, proxies of a target and evaluation by groups, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import dialogues, proxies
from parley.plans.models import _items
from parley.registry import register
from parley.sources.tables import predictions, ratings, utterances, with_views

# Words and marks stand for ids, which SQL can count too.
_TOKEN = r"[A-Za-z0-9]+|[^A-Za-z0-9 \n]"
_MOST, _CONTEXT = 150, 5


def _said(spark, sf):
    return utterances(spark, sf).selectExpr("conv_id", "idx", "concat(role, idx % 3) AS speaker", "role", "text")


def _windows(spark, sf):
    count = lambda c: F.size(F.regexp_extract_all(c, F.lit(_TOKEN), 0))
    head = F.concat("speaker", F.lit(" ("), "role", F.lit("): "))
    said = _said(spark, sf)
    rows = said.select("conv_id", "idx", count(dialogues.line(F.col("speaker"), F.col("role"), F.col("text"))).alias("n_line"), (count(F.concat(head, "text")) + 1).alias("n_target"), count(F.col("text")).alias("n_text"))
    return said, dialogues.windows(rows, _MOST, _CONTEXT)


def _contexts(spark, sf):
    said, shown = _windows(spark, sf)
    return dialogues.context_texts(said, shown).select("conv_id", "idx", F.length("context").alias("n_chars"), F.md5("context").alias("digest"))


_n = lambda t: f"len(regexp_extract_all({t}, '[A-Za-z0-9]+|[^A-Za-z0-9 \\n]'))"
_HEAD = "role || (idx % 3) || ' (' || role || '): '"
SHOWN = f"""(WITH u AS (SELECT conv_id, idx, row_number() OVER w - 1 AS pos, {_HEAD} || text || chr(32) || chr(10) AS line, {_n(f'{_HEAD} || text')} AS n, {_n('text')} AS n_text FROM utterances WINDOW w AS (PARTITION BY conv_id ORDER BY idx)),
    s AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, {_MOST} - 2 - n - 1 AS quota FROM u),
    b AS (SELECT a.conv_id, a.idx, a.pos, a.n, a.n_text, a.before, CASE WHEN a.quota <= 0 THEN a.pos WHEN max(a.before - b.before) <= a.quota THEN min(b.pos) ELSE min(b.pos) FILTER (a.before - b.before < a.quota) END AS first_pos FROM s a JOIN s b ON a.conv_id = b.conv_id AND b.pos <= a.pos AND b.pos >= a.pos - {_CONTEXT} GROUP BY a.conv_id, a.idx, a.pos, a.n, a.n_text, a.before, a.quota)
    SELECT b.conv_id, b.idx, b.pos, first_pos, CASE WHEN first_pos < b.pos THEN f.idx END AS first_idx, b.pos - first_pos AS n_context, CAST(b.before - f.before AS BIGINT) AS context_ids, CAST(2 + b.before - f.before + b.n AS BIGINT) AS n_ids, CAST(2 + b.before - f.before + b.n - b.n_text AS BIGINT) AS start FROM b JOIN s f ON f.conv_id = b.conv_id AND f.pos = first_pos)"""
register("dialogue_windows", lambda s, d: _windows(s, d)[1], with_views(f"SELECT * EXCLUDE (pos, first_pos) FROM {SHOWN}", "utterances"))
register("dialogue_contexts", _contexts, with_views(f"SELECT x.conv_id, x.idx, length(coalesce(string_agg(line, '' ORDER BY u.pos), '')) AS n_chars, md5(coalesce(string_agg(line, '' ORDER BY u.pos), '')) AS digest FROM {SHOWN} x LEFT JOIN (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS pos, {_HEAD} || text || chr(32) || chr(10) AS line FROM utterances) u ON u.conv_id = x.conv_id AND u.pos >= first_pos AND u.pos < x.pos GROUP BY 1, 2", "utterances"))


def _features(spark, sf):
    raters = ratings(spark, sf).groupBy("conv_id", "utterance_id").agg(F.count("*").alias("n_ratings"), F.min("rating").alias("lowest"))
    return _items(spark, sf).drop("info", "fold").withColumn("role", F.lit("x")).join(raters, ["conv_id", "utterance_id"])


def _human(spark, sf):
    return ratings(spark, sf).where("aspect = 'A'").groupBy("conv_id", "utterance_id").agg(F.avg("rating").alias("y_cont"))


def _modelled(spark, sf):
    return predictions(spark, sf).where("aspect = 'R' and model = 'm1' and context = 'full'").groupBy("conv_id", "utterance_id").agg(F.avg("rating").alias("guess"))


_ON = ["conv_id", "utterance_id"]
_FEATURES = "(SELECT conv_id, utterance_id, max(rating) FILTER (aspect = 'N') AS novo, max(rating) FILTER (aspect = 'R') AS relv, utterance_id % 17 AS length, count(*) AS n_ratings, min(rating) AS lowest FROM ratings GROUP BY 1, 2)"
_COLUMNS = ("novo", "relv", "length", "n_ratings", "lowest")


def _proxy_sql(target: str, only: str = "") -> str:
    long = " UNION ALL ".join(f"SELECT '{c}' AS proxy, t.y AS x, CAST({c} AS DOUBLE) AS y FROM {_FEATURES} JOIN ({target}) t USING (conv_id, utterance_id) {only} WHERE t.y IS NOT NULL AND {c} IS NOT NULL" for c in _COLUMNS)
    rank = lambda v: f"rank() OVER (PARTITION BY proxy ORDER BY {v}) + (count(*) OVER (PARTITION BY proxy, {v}) - 1) / 2.0"
    return f"SELECT *, CAST(row_number() OVER (ORDER BY abs(spearman) DESC NULLS LAST, proxy) AS INT) AS rank FROM (SELECT proxy, round(CASE WHEN NOT isnan(corr(rx, ry)) THEN corr(rx, ry) END, 6) AS spearman, round(CASE WHEN NOT isnan(corr(x, y)) THEN corr(x, y) END, 6) AS pearson, count(*) AS n FROM (SELECT *, {rank('x')} AS rx, {rank('y')} AS ry FROM ({long})) GROUP BY 1 HAVING count(*) >= 10)"


_PEOPLE = "SELECT conv_id, utterance_id, avg(rating) AS y FROM ratings WHERE aspect = 'A' GROUP BY 1, 2"
register("proxies_of_people", lambda s, d: proxies.proxies(_features(s, d), _human(s, d), _ON, "y_cont", ["role"]).drop("spearman_p", "pearson_p"), with_views(_proxy_sql(_PEOPLE), "ratings"))
register("proxies_of_models", lambda s, d: proxies.proxies(_features(s, d), _modelled(s, d), _ON, "guess", ["role"], _human(s, d).select(*_ON)).drop("spearman_p", "pearson_p"), with_views(_proxy_sql("SELECT conv_id, utterance_id, avg(rating) AS y FROM preds WHERE aspect = 'R' AND model = 'm1' AND context = 'full' GROUP BY 1, 2", f"SEMI JOIN ({_PEOPLE}) p USING (conv_id, utterance_id)"), "preds"))
_matrix_pairs = [(a, b) for i, a in enumerate(_COLUMNS) for b in _COLUMNS[i + 1 :]]
_ranked = ", ".join(f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in _COLUMNS)
register("correlation_matrix", lambda s, d: proxies.matrix(_features(s, d), _ON, list(_COLUMNS)), with_views(f"SELECT * FROM (WITH f AS (SELECT *, {_ranked} FROM {_FEATURES} WHERE novo IS NOT NULL AND relv IS NOT NULL) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(corr({a}, {b}), 6) AS pearson, round(corr(r_{a}, r_{b}), 6) AS spearman, count(*) AS n FROM f" for a, b in _matrix_pairs) + ")", "ratings"))


def _targeted(spark, sf):
    return _features(spark, sf).join(_human(spark, sf), _ON)


# Without SQL, for the folds hang on a hash: tested against numpy.
register("proxy_evaluation", lambda s, d: proxies.evaluate_proxies(_targeted(s, d), "y_cont", ["novo", "relv", "lowest"], "conv_id", "length"))
register("feature_comparison", lambda s, d: proxies.compare_features(_targeted(s, d), _ON, "y_cont", ["novo", "relv", "length"], "conv_id"))
