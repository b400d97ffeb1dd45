"""Queries over agreement between raters, and orders and ranks of models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import agreement, comparison
from parley.plans.catalog import COUNTS, ITEM, MAE, MAJORITY, _labels
from parley.plans.features import OTHERS, _scores
from parley.registry import register
from parley.sources.tables import predictions, ratings, with_views

PAIRED = f"SELECT a.conv_id, a.utterance_id, a.aspect, a.rater_id AS ra, b.rater_id AS rb, a.rating AS x, b.rating AS y FROM ratings a JOIN ratings b USING ({ITEM}) WHERE a.rater_id < b.rater_id"
_TYPE = "CASE WHEN aspect = 'A' THEN 'info' WHEN aspect IN ('N', 'R') THEN 'mix' END"
REPORT = f"""(WITH k AS (SELECT conv_id, {_TYPE} AS task_type, aspect, ra, rb, coalesce(kappa_present, CAST('NaN' AS DOUBLE)) AS k FROM {_scores(PAIRED, 'conv_id, aspect, ra, rb', None)} WHERE n >= 3),
    e AS (SELECT conv_id, task_type, unnest([ra, rb]) AS rater_id, k FROM (SELECT conv_id, task_type, ra, rb, avg(k) AS k FROM k GROUP BY 1, 2, 3, 4)),
    m AS (SELECT conv_id, task_type, rater_id, avg(k) AS mean, count(*) AS n_pairs FROM e GROUP BY 1, 2, 3),
    w AS (SELECT conv_id, task_type, rater_id, bool_or(m < -0.2) AS low_aspect FROM (SELECT conv_id, task_type, aspect, rater_id, avg(k) AS m FROM (SELECT conv_id, task_type, aspect, unnest([ra, rb]) AS rater_id, k FROM k) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3),
    r AS (SELECT conv_id, task_type, rater_id, CASE WHEN NOT isnan(mean) THEN mean END AS mean_qwk, coalesce(n_pairs, 0) AS n_pairs, low_aspect FROM (SELECT DISTINCT conv_id, {_TYPE} AS task_type, rater_id FROM ratings) LEFT JOIN m USING (conv_id, task_type, rater_id) LEFT JOIN w USING (conv_id, task_type, rater_id)),
    l AS (SELECT *, coalesce(mean_qwk IS NOT NULL AND (mean_qwk < 0.3 OR low_aspect), false) AS low, row_number() OVER (PARTITION BY conv_id, task_type ORDER BY round(mean_qwk, 9) DESC NULLS LAST, n_pairs DESC, rater_id) AS rk FROM r)
    SELECT conv_id, task_type, rater_id, round(mean_qwk, 6) AS mean_qwk, n_pairs, CASE WHEN count(*) FILTER (NOT low) OVER (PARTITION BY conv_id, task_type) < 2 THEN rk > 2 ELSE low END AS dropped FROM l)"""
KEPT = f"(SELECT *, {_TYPE} AS task_type FROM ratings) ANTI JOIN (SELECT * FROM {REPORT} WHERE dropped) USING (conv_id, task_type, rater_id)"
_F = ", ".join(f"round(({' + '.join(f'c{j}' for j in range(1, k + 1))}) / n, 9) AS f{k}" for k in range(1, 5))
_near = lambda k: f"list_min([{', '.join(f'''{{'d': round(abs(g[{j}] - f{k}), 9), 'k': {j}}}''' for j in range(1, 5))}]).k"
LINKED = f"""(WITH kept AS (SELECT * FROM {KEPT}), own AS (SELECT conv_id, aspect, rater_id, {_F} FROM (SELECT conv_id, aspect, rater_id, {COUNTS} FROM kept GROUP BY ALL)), whole AS (SELECT conv_id, aspect, [f1, f2, f3, f4] AS g FROM (SELECT conv_id, aspect, {_F} FROM (SELECT conv_id, aspect, {COUNTS} FROM kept GROUP BY ALL))),
    t AS (SELECT conv_id, aspect, rater_id, {", ".join(f"{_near(k)} AS t{k}" for k in range(1, 5))} FROM own JOIN whole USING (conv_id, aspect))
    SELECT {ITEM}, CAST(CASE rating WHEN 1 THEN t1 WHEN 2 THEN greatest(t1, t2) WHEN 3 THEN greatest(t1, t2, t3) ELSE greatest(t1, t2, t3, t4) END AS INT) AS rating FROM kept JOIN t USING (conv_id, aspect, rater_id))"""


def _rated(name, operator, sql):
    register(name, lambda spark, sf: operator(ratings(spark, sf)), with_views(sql, "ratings"))


_rated("outlier_report", agreement.outlier_report, f"SELECT * FROM {REPORT}")
_rated("final_labels", agreement.final_labels, _labels(LINKED, 0.5))
_rated("pairwise_baselines", agreement.pairwise_baselines, f"SELECT aspect, round(avg(kappa_present), 5) AS qwk, round(avg(accuracy), 5) AS accuracy, round(avg(macro_f1), 5) AS macro_f1, round(avg(mse), 5) AS mse, count(*) AS n_pairs FROM {_scores(PAIRED, 'aspect, ra, rb', None)} WHERE n >= 3 GROUP BY 1")
_rated("rater_confusion", agreement.rater_confusion, f"WITH p AS ({PAIRED}) SELECT aspect, ra, rb, x, y, count(*) AS n FROM (SELECT aspect, ra, rb, x, y FROM p UNION ALL SELECT aspect, 0, 0, x, y FROM p UNION ALL SELECT aspect, 0, 0, y, x FROM p) GROUP BY ALL".replace("WITH p AS", "SELECT * FROM (WITH p AS") + ")")

_tops = {"lower": "list_min(ties)", "upper": "list_max(ties)", "prior": "list_min(list_filter(ties, lambda k: q[k] = list_max(list_transform(ties, lambda j: q[j]))))"}
_halves = {"down": "lo", "up": "lo + 1", "even": "lo + lo % 2", "prior": "CASE WHEN q[lo] >= q[least(4, lo + 1)] THEN lo ELSE lo + 1 END"} | {f"soft_{m}": t for m, t in _tops.items()}
_rule = lambda half, tie: f"CAST(CASE WHEN n = 2 THEN CASE WHEN mean = lo THEN lo ELSE {half} END WHEN med = floor(med) THEN med ELSE {tie} END AS INT)"
_rated("label_rules", agreement.label_rules, f"""SELECT {ITEM}, {', '.join(f"{_rule(h, _tops['lower'])} AS half_{m}" for m, h in _halves.items())}, {', '.join(f"{_rule('lo', t)} AS tie_{m}" for m, t in _tops.items())}, CAST(CASE WHEN med = floor(med) THEN med ELSE {_tops['lower']} END AS INT) AS median_then_soft
    FROM (SELECT *, CAST(floor(mean) AS INT) AS lo, list_filter([1, 2, 3, 4], lambda k: [c1, c2, c3, c4][k] = greatest(c1, c2, c3, c4)) AS ties FROM (SELECT {ITEM}, {COUNTS}, median(rating) AS med, avg(rating) AS mean FROM ratings GROUP BY ALL), (SELECT [avg(CAST(rating = 1 AS INT)), avg(CAST(rating = 2 AS INT)), avg(CAST(rating = 3 AS INT)), avg(CAST(rating = 4 AS INT))] AS q FROM ratings))""")

_BOTH = f"""SELECT 'LOO' AS variant, aspect, rater_id, rating, gold, label FROM {OTHERS.replace("AS label", "AS label, mean AS gold")} UNION ALL
    SELECT 'biased', aspect, rater_id, rating, mean, y_hard FROM ratings JOIN (SELECT {ITEM}, avg(rating) AS mean FROM ratings GROUP BY ALL) USING ({ITEM}) JOIN ({_labels('ratings', 0.0)}) USING ({ITEM})"""
_rated("rater_vs_gold", agreement.against_gold, f"""SELECT * FROM (WITH b AS ({_BOTH}) SELECT variant, aspect, rater_id, s.mse, s.mae, macro_f1, kappa_present AS qwk, accuracy, n AS n_items FROM (SELECT variant, aspect, rater_id, round(avg((rating - gold) ** 2), 6) AS mse, round(avg(abs(rating - gold)), 6) AS mae FROM b GROUP BY ALL) s
    JOIN {_scores('SELECT variant, aspect, rater_id, label AS x, rating AS y FROM b', 'variant, aspect, rater_id')} h USING (variant, aspect, rater_id))""")

_VOTED = f"SELECT model, context, run, aspect, vote AS x, rating AS y FROM preds JOIN {MAJORITY} USING ({ITEM})"
METHODS = f"SELECT aspect, model || '/' || context AS method, round(avg(mse), 3) AS mse, round(avg(kappa_fixed), 3) AS kappa FROM {_scores(_VOTED, 'model, context, run, aspect')} GROUP BY 1, 2"
RANKS = f"SELECT *, (rank_mse + rank_kappa) / 2.0 AS rank_combined FROM (SELECT *, CAST(rank() OVER (PARTITION BY aspect ORDER BY mse) AS INT) AS rank_mse, CAST(rank() OVER (PARTITION BY aspect ORDER BY kappa DESC) AS INT) AS rank_kappa FROM ({METHODS}))"


def _predicted(name, operator, sql):
    register(name, lambda spark, sf: operator(predictions(spark, sf), ratings(spark, sf)), with_views(sql, "preds"))


_predicted("method_means", comparison.method_means, METHODS)
_predicted("aspect_ranks", comparison.aspect_ranks, RANKS)
_predicted("overall_ranks", comparison.overall_ranks, f"SELECT method, {', '.join(f'CAST(rank() OVER (ORDER BY {c}) AS INT) AS {c}' for c in ('rank_mse', 'rank_kappa', 'rank_combined'))} FROM (SELECT method, {', '.join(f'round(avg({c}), 6) AS {c}' for c in ('rank_mse', 'rank_kappa', 'rank_combined'))} FROM ({RANKS}) GROUP BY 1)")
_predicted("model_order", comparison.model_order, f"SELECT *, CAST(row_number() OVER (ORDER BY kappa DESC, mae, accuracy DESC, mse, model, context) AS INT) AS rank FROM (SELECT model, context, kappa_fixed AS kappa, mae, accuracy, mse FROM {_scores(_VOTED, 'model, context')})")
_predicted("soft_scores", comparison.soft_scores, f"SELECT model, context, round(avg(abs(rating - y)), 6) AS mae, round(sqrt(avg((rating - y) ** 2)), 6) AS rmse, round(avg(abs(rating - y)) / nullif(max(y) - min(y), 0), 6) AS normalised_mae, count(*) AS n FROM preds JOIN (SELECT {ITEM}, avg(rating) AS y FROM ratings GROUP BY ALL) USING ({ITEM}) GROUP BY 1, 2")
_predicted("listed_order", lambda p, r: comparison.listed_order(p, r, ["m2", "m0"]), f"SELECT model, context, aspect, mae, CAST(row_number() OVER (ORDER BY coalesce(list_position(['m2', 'm0'], model), 3), context, aspect) AS INT) AS position FROM ({MAE})")
_predicted("truth_by_span", lambda p, r: comparison.truth_by_span(r), f"""SELECT span, conv_id, utterance_id, aspect, round(avg(rating), 6) AS soft, any_value(y_hard) AS hard FROM ratings JOIN (SELECT conv_id, utterance_id // 10 AS span, min(utterance_id) AS low, max(utterance_id) AS high FROM ratings GROUP BY 1, 2) t USING (conv_id)
    JOIN ({_labels('ratings', 0.0)}) USING ({ITEM}) WHERE utterance_id BETWEEN low AND high GROUP BY 1, 2, 3, 4""")
_predicted("coverage_gaps", comparison.coverage_gaps, f"SELECT model, context, run, count(*) AS n_missing FROM (SELECT DISTINCT model, context, run FROM preds), (SELECT DISTINCT {ITEM} FROM ratings) i WHERE NOT EXISTS (SELECT 1 FROM preds p WHERE p.model = model AND p.conv_id = i.conv_id AND p.utterance_id = i.utterance_id AND p.aspect = i.aspect AND p.rating > 1) GROUP BY 1, 2, 3".replace("(SELECT DISTINCT model, context, run FROM preds), ", "(SELECT DISTINCT model, context, run FROM preds) m, ").replace("p.model = model", "p.model = m.model AND p.context = m.context AND p.run = m.run"))

GRID_WAYS = {"min": "least(x, y, z)", "max": "greatest(x, y, z)", "mean": "(x + y + z) / 3", "median": "x + y + z - greatest(x, y, z) - least(x, y, z)", "geometric": "exp((ln(x) + ln(y) + ln(z)) / 3)", "harmonic": "3 / (1 / x + 1 / y + 1 / z)", "power2": "sqrt((x * x + y * y + z * z) / 3)", "softmax": "(x * exp(x) + y * exp(y) + z * exp(z)) / (exp(x) + exp(y) + exp(z))"}
_AGGREGATES = {"mean": "avg(rating)", "max": "max(rating)", "min": "min(rating)", "median": "median(rating)", "harmonic": "count(*) / sum(1.0 / rating)", "top2": "list_avg(list_sort(list(rating), 'DESC')[1:2])", "top_quarter": "list_avg(list_sort(list(rating), 'DESC')[1:CAST(ceil(count(*) * 0.25) AS INT)])", "top_half": "list_avg(list_sort(list(rating), 'DESC')[1:CAST(ceil(count(*) * 0.5) AS INT)])"}
_GRID = " UNION ALL ".join(f"SELECT '{m}' AS method, conv_id, utterance_id, any_value(v) FILTER (aspect = 'A') AS x, any_value(v) FILTER (aspect = 'N') AS y, any_value(v) FILTER (aspect = 'R') AS z FROM (SELECT {ITEM}, {f} AS v FROM ratings GROUP BY ALL) GROUP BY 1, 2, 3" for m, f in _AGGREGATES.items())
_rated("mae_grid", comparison.mae_grid, f"SELECT * FROM (WITH g AS ({_GRID}), t AS (SELECT conv_id, utterance_id, avg(rating) AS truth FROM ratings WHERE aspect = 'A' GROUP BY 1, 2) " + " UNION ALL ".join(f"SELECT method, '{k}' AS combiner, round(avg(abs({v} - truth)), 5) AS mae, count(*) AS n FROM g JOIN t USING (conv_id, utterance_id) WHERE x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL GROUP BY 1" for k, v in GRID_WAYS.items()) + ")")
