"""Queries over claims, task allocation, ranges of agreement, correlations and regressions, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import allocation, claims, evaluation, metrics, nested, ranks, regression
from parley.operators.memory import ACTIONS
from parley.plans.catalog import COUNTS, ITEM, MAE, MAJORITY, WIDE
from parley.plans.features import ASPECTS, OTHERS, _scores
from parley.registry import register
from parley.sources.tables import predictions, ratings, table, utterances, with_views

_span = lambda sd: f"""round(avg(k), 5) AS mean_qwk, round({sd}(k), 5) AS sd_qwk, round(greatest(-1, least(1, avg(k) - {sd}(k))), 5) AS lower,
    round(greatest(-1, least(1, avg(k) + {sd}(k))), 5) AS upper, round(min(k), 5) AS min_qwk, round(max(k), 5) AS max_qwk, count(k) AS n"""  # noqa: E731
register("human_kappa_range", lambda s, d: metrics.human_kappa_range(ratings(s, d)), with_views(f"SELECT aspect, {_span('stddev_pop')} FROM (SELECT aspect, kappa_present AS k FROM {_scores(f'SELECT aspect, rater_id, label AS x, rating AS y FROM {OTHERS}', 'aspect, rater_id')}) GROUP BY 1", "ratings"))
register("model_kappa_range", lambda s, d: metrics.model_kappa_range(predictions(s, d), ratings(s, d)), with_views(f"SELECT aspect, {_span('stddev_samp')} FROM (SELECT aspect, kappa_fixed AS k FROM {_scores(f'SELECT aspect, model, context, vote AS x, rating AS y FROM preds JOIN {MAJORITY} USING ({ITEM})', 'aspect, model, context')}) GROUP BY 1", "preds"))
_LABEL = f"""(SELECT {ITEM}, CAST(CASE WHEN n = 2 THEN floor(mean) WHEN med = floor(med) THEN med WHEN c1 = most THEN 1 WHEN c2 = most THEN 2 WHEN c3 = most THEN 3 ELSE 4 END AS INT) AS label
    FROM (SELECT *, greatest(c1, c2, c3, c4) AS most FROM (SELECT {ITEM}, {COUNTS}, median(rating) AS med, avg(rating) AS mean FROM ratings WHERE rater_id <> 1 GROUP BY ALL)))"""
register("seed_comparison", lambda s, d: metrics.against_seed(ratings(s, d), 1), with_views(f"SELECT aspect, mse, kappa_present AS kappa, accuracy, n FROM {_scores(f'SELECT aspect, rating AS x, label AS y FROM ratings JOIN {_LABEL} USING ({ITEM}) WHERE rater_id = 1', 'aspect')}", "ratings"))
register("pruned_raters", lambda s, d: metrics.prune(ratings(s, d), 4))


def _complete(spark, sf):
    return allocation.complete(nested.nest_annotations(ratings(spark, sf)), ASPECTS)


register("annotation_complete", _complete, with_views("SELECT conv_id, rater_id, utterance_id, count(DISTINCT aspect) = 3 AS complete FROM ratings GROUP BY 1, 2, 3", "ratings"))

# Claims: a line of an order is a claim, an order an utterance.
CLAIMS = """SELECT l_orderkey % 40 AS conv_id, l_orderkey AS utterance_id, l_linenumber AS claim_id, max(CAST(floor(l_quantity) AS INT) % 4 + 1) AS info, max(CAST(floor(l_discount * 100 + 0.5) AS INT) % 4 + 1) AS novo,
    max(CAST(floor(l_tax * 100 + 0.5) AS INT) % 4 + 1) AS relv, max(CAST(floor(l_extendedprice) AS INT) % 4 + 1) AS imsc, max(CASE l_returnflag WHEN 'A' THEN 'ADD' WHEN 'R' THEN 'UPDATE' ELSE 'NONE' END) AS action,
    max(CASE l_linestatus WHEN 'O' THEN 'forward entailment' ELSE 'contradiction' END) AS relation FROM {lines} GROUP BY l_orderkey, l_linenumber"""
SAID = "SELECT o_orderkey % 40 AS conv_id, o_orderkey AS utterance_id, o_orderpriority AS text, o_custkey AS speaker FROM {orders}"
_CTE = f"WITH claims AS ({CLAIMS.format(lines='lineitem')}), said AS ({SAID.format(orders='orders')}) "


def _claims(spark, sf):
    return spark.sql(CLAIMS.format(lines="{t}"), t=table(spark, sf, "lineitem"))


def _orders(spark, sf):
    return spark.sql(SAID.format(orders="{t}"), t=table(spark, sf, "orders"))


_filled = lambda value, name: f"round(coalesce({value}, 1.0), 6) AS {name}"
_head = lambda s, m: f"list_avg({s}[1:{m}])"
_quart = lambda q: f"greatest(1, CAST(ceil(n_claims * {q}) AS INT))"
_stats = ", ".join(
    _filled(v, f"{k}_{s}")
    for s in claims.SCALES
    for k, v in {"mean": f"list_avg({s})", "max": f"{s}[1]", "min": f"{s}[-1]", "median": f"list_median({s})", "harmonic": f"n_claims / list_sum(list_transform({s}, lambda x: 1.0 / x))", "top2": _head(s, "2"), "top_quarter": _head(s, _quart(0.25)), "top_half": _head(s, _quart(0.5))}.items()
)
_kinds = [f"act_{a}" for a in ACTIONS] + [f"rel_{r.replace(' ', '_')}" for r in claims.RELATIONS]
_entropy = lambda prefix: f"list_sum(list_transform([{', '.join(k for k in _kinds if k.startswith(prefix))}], lambda x: -(x / CAST(n_claims AS DOUBLE)) * log2(x / CAST(n_claims AS DOUBLE) + 1e-12)))"
_SQL_FEATURES = f"""{_CTE} SELECT conv_id, utterance_id, n_tokens, coalesce(n_claims, 0) AS n_claims, coalesce(n_changes, 0) AS n_changes, round(coalesce(n_changes / n_claims, 0), 6) AS p_changes, round(coalesce(n_claims, 0) / greatest(1, n_tokens), 6) AS claim_density,
    round(coalesce(n_changes, 0) / greatest(1, n_tokens), 6) AS change_density, {_stats}, {', '.join(_filled(f'{k} / n_claims', f'share_{k}') for k in _kinds)}, {_filled(_entropy('act_'), 'act_entropy')}, {_filled(_entropy('rel_'), 'rel_entropy')}
    FROM (SELECT conv_id, utterance_id, len(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9][A-Za-z0-9''\\-]*')) AS n_tokens FROM said) LEFT JOIN (SELECT conv_id, utterance_id, count(*) AS n_claims, count(*) FILTER (action <> 'NONE') AS n_changes,
    {', '.join(f'list({s} ORDER BY {s} DESC) AS {s}' for s in claims.SCALES)}, {', '.join(f"count(*) FILTER (action = '{a}') AS act_{a}" for a in ACTIONS)}, {', '.join(f"count(*) FILTER (relation = '{r}') AS rel_{r.replace(' ', '_')}" for r in claims.RELATIONS)} FROM claims GROUP BY 1, 2) USING (conv_id, utterance_id)"""
register("claim_features", lambda s, d: claims.claim_features(_claims(s, d), _orders(s, d)), _SQL_FEATURES)
_gated = ", ".join(f"count(*) FILTER (action <> 'NONE' AND {g}) AS delta_{n}" for n, g in [(s, f"{s} > 2") for s in claims.SCALES] + [("triad", "novo > 2 AND relv > 2 AND imsc > 2")])
_names = ["claim_count", "mem_delta", *(f"delta_{s}" for s in claims.SCALES), "delta_triad"]
register("memory_deltas", lambda s, d: claims.memory_deltas(_claims(s, d), _orders(s, d)), f"{_CTE} SELECT conv_id, utterance_id, {', '.join(f'coalesce({n}, 0) AS {n}' for n in _names)}, claim_count IS NOT NULL AS used FROM said LEFT JOIN (SELECT conv_id, utterance_id, count(*) AS claim_count, count(*) FILTER (action <> 'NONE') AS mem_delta, {_gated} FROM claims GROUP BY 1, 2) USING (conv_id, utterance_id)")


def _claim_actions(spark, sf):
    rows = _claims(spark, sf)
    rated = rows.groupBy(*claims.KEY).agg(F.collect_list(F.struct("claim_id", *claims.SCALES)).alias("claims"))
    acted = rows.where("claim_id % 3 > 0").groupBy(*claims.KEY).agg(F.collect_list(F.struct("claim_id", "action", "relation")).alias("actions"))
    return claims.join_actions(rated, acted)


register("claim_actions", _claim_actions, f"{_CTE} SELECT conv_id, utterance_id, claim_id, info, novo, relv, imsc, CASE WHEN claim_id % 3 > 0 THEN action END AS action, CASE WHEN claim_id % 3 > 0 THEN relation END AS relation FROM claims")
_digest = lambda df, c: df.select("conv_id", F.length(c).alias("n_chars"), F.md5(c).alias("digest"))
register("memory_lines", lambda s, d: _digest(claims.memory_lines(_claims(s, d).selectExpr("conv_id", "utterance_id AS turn_id", "CASE WHEN claim_id > 1 THEN action END AS speaker", "relation AS claim")), "memories"),
         f"{_CTE} SELECT conv_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT conv_id, string_agg(line, '' ORDER BY utterance_id, line) AS t FROM (SELECT conv_id, utterance_id, '- (Turn #' || utterance_id || ') ' || CASE WHEN claim_id > 1 THEN action ELSE 'Unknown' END || ': \"' || relation || '\"' || chr(10) AS line FROM claims) GROUP BY 1)")
register("transcript_text", lambda s, d: _digest(claims.transcript(utterances(s, d).withColumn("speaker", F.col("role"))), "transcript"),
         with_views("SELECT conv_id, length(t) AS n_chars, md5(t) AS digest FROM (SELECT conv_id, string_agg(line, chr(10) || chr(10) ORDER BY idx, line) AS t FROM (SELECT conv_id, idx, idx || '. ' || coalesce(role, '') || ' (' || coalesce(role, '') || '): ' || coalesce(text, '') AS line FROM utterances) GROUP BY 1)", "utterances"))


def _known(spark, sf):
    said = utterances(spark, sf)
    starts = said.where("idx % 4 = 0").selectExpr("conv_id", "idx div 4 AS segment", "idx AS start")
    return claims.known_at(starts, said.where("role = 'user'").selectExpr("conv_id", "idx AS turn_id", "length(text) AS claim"))


register("known_memories", _known, with_views("SELECT a.conv_id, a.idx // 4 AS segment, b.idx AS turn_id, length(b.text) AS claim FROM utterances a JOIN utterances b ON a.conv_id = b.conv_id AND b.idx < a.idx WHERE a.idx % 4 = 0 AND b.role = 'user'", "utterances"))

# Allocation: events stand for what users did in groups of tasks.
_GROUPS = "SELECT DISTINCT event_id % 60 AS group_id, CAST(event_id % 60 % 5 AS BIGINT) AS n_participants FROM {events}"
_DID = "SELECT DISTINCT user_id, event_id % 60 AS group_id FROM {events} WHERE event_id % 3 = 0"


def _next_group(spark, sf):
    events = table(spark, sf, "events")
    groups, did = (spark.sql(q.format(events="{e}"), e=events) for q in (_GROUPS, _DID))
    return allocation.next_group(events, groups, did)


register("next_group", _next_group, f"""WITH g AS ({_GROUPS.format(events='events')}), d AS ({_DID.format(events='events')}) SELECT user_id, arg_min(group_id, pos) AS group_id FROM (SELECT DISTINCT user_id FROM events)
    LEFT JOIN (SELECT * FROM (SELECT u.user_id, group_id, pos FROM (SELECT DISTINCT user_id FROM events) u, (SELECT *, row_number() OVER (ORDER BY n_participants DESC, group_id) AS pos FROM g WHERE n_participants < 3)) c ANTI JOIN d ON c.user_id = d.user_id AND c.group_id = d.group_id) USING (user_id) GROUP BY 1""")


def _progress(spark, sf):
    events = table(spark, sf, "events")
    tasks = events.selectExpr("event_id % 60 AS group_id", "event_id % 600 AS task_id").distinct()
    return allocation.progress(tasks, events.selectExpr("user_id", "event_id % 600 AS task_id"))


register("task_progress", _progress, "SELECT user_id, task_id % 60 AS group_id, count(*) AS n_done, any_value(n_tasks) AS n_tasks, round(count(*) / any_value(n_tasks), 6) AS progress FROM (SELECT DISTINCT user_id, event_id % 600 AS task_id FROM events) JOIN (SELECT event_id % 60 AS g, count(DISTINCT event_id % 600) AS n_tasks FROM events GROUP BY 1) ON task_id % 60 = g GROUP BY 1, 2")
_KINDS = ("info_cur", "info_done", "mix_cur", "mix_done")
register("task_type", lambda s, d: allocation.task_type(table(s, d, "events").groupBy(F.expr("event_id % 60").alias("group_id")).agg(*(F.collect_set(F.when(F.col("event_id") % 7 == m, F.col("user_id"))).alias(k) for m, k in enumerate(_KINDS)))),
         "SELECT *, CASE WHEN n_info <= n_mix THEN 'info' ELSE 'mix' END AS task_type FROM (SELECT event_id % 60 AS group_id, CAST(count(DISTINCT user_id) FILTER (event_id % 7 = 0) + count(DISTINCT user_id) FILTER (event_id % 7 = 1) AS INT) AS n_info, CAST(count(DISTINCT user_id) FILTER (event_id % 7 = 2) + count(DISTINCT user_id) FILTER (event_id % 7 = 3) AS INT) AS n_mix FROM events GROUP BY 1)")
register("task_upload", lambda s, d: allocation.upload(utterances(s, d).select("conv_id", F.concat(F.lit("task_"), "idx").alias("task_id"))).select("conv_id", F.array_join("tasks", ",").alias("tasks"), "n_tasks"),
         with_views("SELECT conv_id, string_agg('task_' || idx, ',' ORDER BY idx) AS tasks, count(*) AS n_tasks FROM utterances GROUP BY 1", "utterances"))


def _mae_table(spark, sf):
    return allocation.best_marks(evaluation.mae_by_context(predictions(spark, sf), ratings(spark, sf)), ["model", "context"], "aspect", "mae", ASPECTS)


register("mae_table", _mae_table, with_views(f"""SELECT model, context, {', '.join(f"coalesce(max(cell) FILTER (aspect = '{a}'), '-') AS {a}" for a in ASPECTS)} FROM (SELECT *, CASE WHEN mae = min(mae) OVER (PARTITION BY aspect) THEN '\\textbf{{' || printf('%.3f', mae) || '}}' ELSE printf('%.3f', mae) END AS cell FROM ({MAE})) GROUP BY 1, 2""", "preds"))

_PAIRS = f"(SELECT unnest([{', '.join(f'''{{'first': '{a}', 'second': '{b}', 'x': {a}, 'y': {b}}}''' for a, b in (('A', 'N'), ('A', 'R'), ('N', 'R')))}], recursive := true) FROM {WIDE})"
register("correlations", lambda s, d: ranks.correlations(evaluation.aspect_pairs(ratings(s, d)), "first", "second").drop("spearman_p", "pearson_p"), with_views(f"""SELECT first, second, round(corr(rx, ry), 6) AS spearman, round(corr(x, y), 6) AS pearson, count(*) AS n
    FROM (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY x) + (count(*) OVER (PARTITION BY first, second, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY first, second ORDER BY y) + (count(*) OVER (PARTITION BY first, second, y) - 1) / 2 AS ry FROM {_PAIRS} WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 10""", "ratings"))
register("correlation_probabilities", lambda s, d: ranks.correlations(evaluation.aspect_pairs(ratings(s, d)), "first", "second"))
register("paired_t", lambda s, d: ranks.paired_t(evaluation.aspect_pairs(ratings(s, d)), "first", "second").drop("p"), with_views(f"SELECT first, second, round(avg(x - y), 6) AS difference, round(avg(x - y) / nullif(stddev_samp(x - y) / sqrt(count(*)), 0), 5) AS t, count(*) AS n FROM {_PAIRS} WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY 1, 2", "ratings"))
register("regression_simple", lambda s, d: regression.simple(evaluation.aspect_pairs(ratings(s, d)), "first", "second"), with_views(f"SELECT first, second, round(regr_slope(y, x), 6) AS slope, round(regr_intercept(y, x), 6) AS intercept, round(regr_r2(y, x), 6) AS r2, regr_count(y, x) AS n FROM {_PAIRS} GROUP BY 1, 2", "ratings"))


def _lines(spark, sf):
    return table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "nullif(l_discount, 0.0) AS l_discount", "l_tax", "l_extendedprice")


register("regression_report", lambda s, d: regression.report(_lines(s, d), "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]))
register("residuals", lambda s, d: regression.residuals(table(s, d, "events").selectExpr("event_id", "event_type", "CAST(user_id AS DOUBLE) AS x", "value AS y"), ["event_id"], "event_type"),
         "SELECT event_id, round(value - b * user_id - a, 6) AS residual FROM events JOIN (SELECT event_type, regr_slope(value, user_id) AS b, regr_intercept(value, user_id) AS a FROM events GROUP BY 1) USING (event_type)")
_z = ", ".join(f"round(coalesce(({c} - avg({c}) OVER ()) / nullif(stddev_pop({c}) OVER (), 0), 0), 6) AS {c}" for c in ("value", "half"))
register("standardised", lambda s, d: regression.standardise(table(s, d, "events").selectExpr("event_id", "value", "CASE WHEN event_id % 3 > 0 THEN value / 2 END AS half"), ["event_id"], ["value", "half"]),
         f"SELECT event_id, {_z} FROM (SELECT event_id, coalesce(value, median(value) OVER ()) AS value, coalesce(half, median(half) OVER ()) AS half FROM (SELECT event_id, value, CASE WHEN event_id % 3 > 0 THEN value / 2 END AS half FROM events))")
