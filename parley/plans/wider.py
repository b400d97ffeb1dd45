"""Queries by corpus, with other rules for ties and ends, and over all columns, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import agreement, comparison, consensus, evaluation, features, metrics, shaping, text
from parley.plans.agreement import _VOTED, PAIRED
from parley.plans.catalog import _M, _O, COUNTS, ITEM, MAJORITY, WIDE, _alpha_of, _labels, _mid
from parley.plans.features import SPANS, _intervals, _scores
from parley.plans.reports import _span
from parley.plans.tasks import _IN_ROLES, _ROLES
from parley.registry import register
from parley.sources.tables import predictions, ratings, utterances, with_views

# Three corpora, by conversation.
_CORPUS = "concat('c', conv_id % 3)"
_corpus = lambda: F.expr(_CORPUS).alias("corpus")

register("model_kappa_by_corpus", lambda s, d: metrics.model_kappa_range(predictions(s, d), ratings(s, d), _corpus()), with_views(f"SELECT corpus, aspect, {_span('stddev_samp')} FROM (SELECT corpus, aspect, kappa_fixed AS k FROM {_scores(f'SELECT {_CORPUS} AS corpus, aspect, model, context, vote AS x, rating AS y FROM preds JOIN {MAJORITY} USING ({ITEM})', 'corpus, aspect, model, context')}) GROUP BY 1, 2", "preds"))

_pairs = " UNION ALL ".join(f"SELECT corpus, '{a}' AS first, '{b}' AS second, {a} AS x, {b} AS y FROM (SELECT *, unnest(['all', {_CORPUS}]) AS corpus FROM {WIDE}) WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for a, b in (("A", "N"), ("A", "R"), ("N", "R")))
_ranked = lambda v: f"rank() OVER (PARTITION BY corpus, first, second ORDER BY {v}) + (count(*) OVER (PARTITION BY corpus, first, second, {v}) - 1) / 2.0"
register("spearman_by_corpus", lambda s, d: evaluation.spearman_by(ratings(s, d), F.expr(_CORPUS)), with_views(f"SELECT corpus, first, second, round(corr(rx, ry), 6) AS rho, count(*) AS n FROM (SELECT *, {_ranked('x')} AS rx, {_ranked('y')} AS ry FROM ({_pairs})) GROUP BY 1, 2, 3", "ratings"))

for _rule, _levels in (("min", (1, 2, 3, 4)), ("max", (4, 3, 2, 1))):
    _top = " ".join(f"WHEN c{k} = most THEN {k}" for k in _levels)
    register(f"majority_{_rule}", lambda s, d, rule=_rule: consensus.majority(ratings(s, d), ties=rule), with_views(f"SELECT {ITEM}, CASE {_top} END AS vote FROM (SELECT *, greatest(c1, c2, c3, c4) AS most FROM (SELECT {ITEM}, {COUNTS} FROM ratings GROUP BY ALL)) WHERE n >= 2", "ratings"))

register("span_marks_open", lambda s, d: features.mark_spans(utterances(s, d).select("conv_id", "idx"), _intervals(utterances(s, d)), closed=False), with_views(f'SELECT u.conv_id, u.idx, max(s.segment) AS segment FROM utterances u LEFT JOIN {SPANS} s ON u.conv_id = s.conv_id AND u.idx >= s."start" AND u.idx < s."end" GROUP BY 1, 2', "utterances"))

_COLUMNS = ("A", "N", "R")


def _grid(of: tuple[str, ...], name: str) -> str:
    known = f"list_filter([{', '.join(of)}], lambda v: v IS NOT NULL)"
    product = " * ".join(of)
    cells = {"min": f"list_min({known})", "max": f"list_max({known})", "mean": f"list_sum({known}) / nullif(len({known}), 0)", "prod": product, "gmean": f"pow(CASE WHEN {product} = 0 THEN 1e-9 ELSE {product} END, 1.0 / {len(of)})"}
    return ", ".join(f"round({v}, 6) AS {n}_{name}" for n, v in cells.items())


register("interaction_grid", lambda s, d: features.interaction_grid(evaluation.wide(ratings(s, d)), list(_COLUMNS), ["conv_id", "utterance_id"]), with_views(f"SELECT conv_id, utterance_id, {', '.join([_grid((a, b), f'{a}_{b}') for a, b in (('A', 'N'), ('A', 'R'), ('N', 'R'))] + [_grid(_COLUMNS, 'agg')])} FROM {WIDE}", "ratings"))

register("rating_summary", lambda s, d: text.summary(ratings(s, d).select(_corpus(), "aspect", F.col("rating").alias("value")), "corpus", "aspect"), with_views(f"SELECT {_CORPUS} AS corpus, aspect, round(avg(rating), 6) AS mean, round(stddev_samp(rating), 6) AS sd, min(rating) AS least, max(rating) AS largest, count(*) AS n FROM ratings GROUP BY 1, 2", "ratings"))

_share = lambda over: f"round(n / nullif(sum(n) OVER (PARTITION BY aspect{over}), 0), 6)"
register("vote_crosstab", lambda s, d: consensus.crosstab(predictions(s, d).join(consensus.majority(ratings(s, d)), ["conv_id", "utterance_id", "aspect"]).select("aspect", F.col("vote").alias("x"), F.col("rating").alias("y")), "aspect"), with_views(f"""SELECT aspect, x, y, n, {_share(', x')} AS row_share, {_share(', y')} AS column_share, {_share('')} AS share
    FROM (SELECT a.aspect, x, y, count(p.aspect) AS n FROM (SELECT DISTINCT aspect FROM preds JOIN {MAJORITY} USING ({ITEM})) a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS x) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS y) LEFT JOIN (SELECT aspect, vote, rating FROM preds JOIN {MAJORITY} USING ({ITEM})) p ON p.aspect = a.aspect AND vote = x AND rating = y GROUP BY 1, 2, 3)""", "preds"))


def _segmented(spark, sf):
    return utterances(spark, sf).select(_corpus(), "conv_id", F.expr("idx div 4").alias("segment_id"), "idx", "role", "text")


_stats = {"u": "utterances", "s": "speakers", "w": "words", "g": "gini", "su": "skipped_utterances", "sw": "skipped_words"}
register("corpus_segments", lambda s, d: text.describe_segments(_segmented(s, d), _ROLES), with_views(f"""SELECT * FROM (WITH u AS (SELECT {_CORPUS} AS corpus, conv_id, idx // 4 AS segment_id, role, len(string_split(text, ' ')) AS n, text FROM utterances),
    f AS (SELECT *, coalesce(lower(trim(role)) IN {_IN_ROLES} OR n <= 3 OR (n <= 5 AND NOT regexp_matches(text, '[.!?]$')), false) AS skip FROM u),
    s AS (SELECT corpus, conv_id, segment_id, count(*) AS u, count(*) FILTER (NOT skip) AS kept, count(DISTINCT role) AS s, avg(n) FILTER (NOT skip) AS w, avg(CAST(skip AS INT)) AS su, coalesce(sum(n) FILTER (skip), 0) / nullif(sum(n), 0) AS sw FROM f GROUP BY 1, 2, 3),
    x AS (SELECT *, row_number() OVER (PARTITION BY corpus, conv_id, segment_id ORDER BY x, role) AS i FROM (SELECT corpus, conv_id, segment_id, role, sum(n) AS x FROM f WHERE NOT skip GROUP BY 1, 2, 3, 4)),
    g AS (SELECT corpus, conv_id, segment_id, coalesce(2.0 * sum(i * x) / nullif(count(*) * sum(x), 0) - (count(*) + 1) / count(*), 0) AS g FROM x GROUP BY 1, 2, 3)
    SELECT c AS corpus, count(*) AS n_segments, CAST(sum(u) AS BIGINT) AS n_utterances, CAST(sum(kept) AS BIGINT) AS n_kept, {', '.join(f'round({f}({c}), 6) AS {n}_{k}' for c, n in _stats.items() for f, k in (('avg', 'mean'), ('stddev_samp', 'sd')))} FROM (SELECT *, unnest([corpus, 'all']) AS c FROM s LEFT JOIN g USING (corpus, conv_id, segment_id)) GROUP BY 1)""", "utterances"))


def _one_model(spark, sf):
    return predictions(spark, sf).where("model = 'm1' and context = 'full' and run = 0")


_NAMED = f"""(SELECT {ITEM}, 'rater ' || rater_id AS rater_id, rating FROM ratings UNION ALL SELECT {ITEM}, 'reference', vote FROM {MAJORITY}
    UNION ALL SELECT {ITEM}, 'model', rating FROM preds WHERE model = 'm1' AND context = 'full' AND run = 0)"""
_ordinal = _alpha_of(lambda i, j: f"(({_mid(i)}) - ({_mid(j)})) ** 2")
register("agreement_report", lambda s, d: agreement.full_report(ratings(s, d), consensus.majority(ratings(s, d)), _one_model(s, d)), with_views(f"""SELECT * FROM (WITH everyone AS {_NAMED}, p AS (SELECT aspect, ra, rb, kappa_present AS kappa, accuracy, n FROM {_scores(PAIRED.replace('ratings', 'everyone'), 'aspect, ra, rb')}),
    a AS (SELECT aspect, {_ordinal} AS alpha FROM (SELECT *, {_M} FROM (SELECT aspect, {_O} FROM (SELECT {ITEM}, {COUNTS} FROM everyone GROUP BY ALL) WHERE n >= 2 GROUP BY aspect))) SELECT p.*, alpha FROM p LEFT JOIN a USING (aspect))""", "preds"))
_each = lambda over: f"round(n / nullif(sum(n) OVER (PARTITION BY aspect, rater_id{over}), 0), 6)"
_BESIDE = f"(SELECT aspect, unnest(['rater ' || rater_id, 'all']) AS rater_id, vote, rating FROM ratings JOIN {MAJORITY} USING ({ITEM}))"
register("reference_crosstab", lambda s, d: agreement.against_reference(ratings(s, d), consensus.majority(ratings(s, d))), with_views(f"""SELECT aspect, rater_id, x, y, n, {_each(', x')} AS row_share, {_each(', y')} AS column_share, {_each('')} AS share
    FROM (SELECT a.aspect, a.rater_id, x, y, count(p.aspect) AS n FROM (SELECT DISTINCT aspect, rater_id FROM {_BESIDE}) a CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS x) CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS y) LEFT JOIN {_BESIDE} p ON p.aspect = a.aspect AND p.rater_id = a.rater_id AND vote = x AND rating = y GROUP BY 1, 2, 3, 4)""", "ratings"))
register("models_by_aspect", lambda s, d: comparison.models_by_aspect(predictions(s, d), ratings(s, d)), with_views(f"SELECT *, CAST(row_number() OVER (PARTITION BY aspect ORDER BY kappa DESC, mae, accuracy DESC, mse, model, context) AS INT) AS rank FROM (SELECT aspect, model, context, kappa_fixed AS kappa, mae, accuracy, mse, n FROM {_scores(_VOTED, 'aspect, model, context')})", "preds"))

_TURNS = "CASE WHEN idx % 3 = 0 THEN ' Moderator ' ELSE role END"
register("normalised_turns", lambda s, d: shaping.normalised_turns(utterances(s, d).selectExpr("conv_id", "idx", f"{_TURNS} AS role", "text", "CASE WHEN idx % 4 > 0 THEN instr(text, 'e') > 0 END AS asks", "idx % 2 AS informs"), ["asks", "informs"]).drop("text"), with_views(f"""SELECT conv_id, idx, role, lower(trim(role)) AS role_norm, CAST(m AS INT) AS is_mod, CAST(length(coalesce(text, '')) AS INT) AS text_len, CASE WHEN m AND idx % 4 > 0 THEN CAST(contains(text, 'e') AS DOUBLE) ELSE 0.0 END AS asks, CASE WHEN m THEN CAST(idx % 2 AS DOUBLE) ELSE 0.0 END AS informs
    FROM (SELECT *, coalesce(lower(trim(role)) IN ('mod', 'moderator'), false) AS m FROM (SELECT conv_id, idx, {_TURNS} AS role, text FROM utterances))""", "utterances"))
_by_aspect = ", ".join(f"max(y_cont) FILTER (aspect = '{a}') AS {a}" for a in _COLUMNS)
register("wide_labels", lambda s, d: shaping.wide_labels(consensus.consensus_labels(ratings(s, d)), utterances(s, d), list(_COLUMNS), "y_cont").withColumn("text", F.md5("text")), with_views(f"SELECT u.conv_id, u.idx AS utterance_id, md5(text) AS text, {_by_aspect} FROM utterances u JOIN ({_labels('ratings', 1.0)}) l ON l.conv_id = u.conv_id AND l.utterance_id = u.idx GROUP BY 1, 2, 3", "ratings", "utterances"))
