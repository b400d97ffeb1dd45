"""Queries over the test tables, each with SQL for an independent engine where SQL can express it."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import adjacency, consensus, evaluation, release, segments, text
from parley.registry import register
from parley.sources.tables import acts, predictions, ratings, table, utterances, with_views

ITEM = "conv_id, utterance_id, aspect"
COUNTS = "count(*) FILTER (rating = 1) AS c1, count(*) FILTER (rating = 2) AS c2, count(*) FILTER (rating = 3) AS c3, count(*) FILTER (rating = 4) AS c4, count(*) AS n"


def _rated(name, operator, sql=None, views=("ratings",)):
    register(name, lambda spark, sf: operator(ratings(spark, sf)), sql and with_views(sql, *views))


def _labels(source: str, alpha: float) -> str:
    p = [f"(c{k} + {alpha}) / (n + {4 * alpha})" for k in (1, 2, 3, 4)]
    entropy = " + ".join(f"({x}) * ln(greatest({x}, 1e-12))" for x in p)
    mask = ", ".join(f"CASE WHEN lo <= {k} AND {k} < hi THEN 0 ELSE 1 END AS mask_t{k}" for k in (1, 2, 3))
    return f"""SELECT {ITEM}, n AS n_raters, CAST(CASE WHEN n = 2 THEN floor(mean) WHEN med = floor(med) THEN med
        WHEN c1 = most THEN 1 WHEN c2 = most THEN 2 WHEN c3 = most THEN 3 ELSE 4 END AS INT) AS y_hard, round(1 + ({entropy}) / ln(4.0), 6) AS w_conf,
        round({" + ".join(f"{k} * {x}" for k, x in enumerate(p, 1))}, 6) AS y_cont, {", ".join(f"round({x}, 6) AS p{k}" for k, x in enumerate(p, 1))}, lo, hi, {mask}
        FROM (SELECT *, greatest(c1, c2, c3, c4) AS most FROM (SELECT {ITEM}, {COUNTS}, median(rating) AS med, avg(rating) AS mean, min(rating) AS lo, max(rating) AS hi FROM {source} GROUP BY ALL))"""


_rated("consensus_labels", consensus.consensus_labels, _labels("ratings", 1.0))

_O = ", ".join(f"sum((c{i} * c{j} - {f'c{i}' if i == j else 0}) / (n - 1.0)) AS o{i}{j}" for i in range(1, 5) for j in range(1, 5))
_M = ", ".join(f"{' + '.join(f'o{i}{j}' for j in range(1, 5))} AS m{i}" for i in range(1, 5))


def _alpha_of(distance) -> str:
    seen, chance = (" + ".join(f"{a(i, j)} * ({distance(i, j)})" for i in range(1, 5) for j in range(1, 5)) for a in (lambda i, j: f"o{i}{j}", lambda i, j: f"m{i} * m{j}"))
    return f"round(1 - (m1 + m2 + m3 + m4 - 1) * ({seen}) / nullif({chance}, 0), 6)"


_mid = lambda k: " + ".join([f"m{j}" for j in range(1, k)] + [f"m{k} / 2"])
_rated("alpha_by_aspect", lambda r: consensus.alpha(r, "aspect"), f"""SELECT aspect, {_alpha_of(lambda i, j: (i - j) ** 2)} AS alpha_interval, {_alpha_of(lambda i, j: int(i != j))} AS alpha_nominal, {_alpha_of(lambda i, j: f"(({_mid(i)}) - ({_mid(j)})) ** 2")} AS alpha_ordinal
    FROM (SELECT *, {_M} FROM (SELECT aspect, {_O} FROM (SELECT {ITEM}, {COUNTS} FROM ratings GROUP BY ALL) WHERE n >= 2 GROUP BY aspect))""")
_rated("calibrate_center", consensus.centre, f"""SELECT {ITEM}, rater_id, rating, CAST(least(4, greatest(1, round_even(round((rating - avg(rating) OVER r) / coalesce(nullif(stddev_pop(rating) OVER r, 0), 1) * stddev_pop(rating) OVER a + avg(rating) OVER a, 6), 0))) AS INT) AS calibrated
    FROM ratings WINDOW r AS (PARTITION BY aspect, rater_id), a AS (PARTITION BY aspect)""")
_F = ", ".join(f"round(({' + '.join(f'c{j}' for j in range(1, k + 1))}) / n, 9) AS f{k}" for k in range(1, 5))
_near = lambda k: f"list_min([{{'d': round(abs(g[1] - f{k}), 9), 'k': 1}}, {{'d': round(abs(g[2] - f{k}), 9), 'k': 2}}, {{'d': round(abs(g[3] - f{k}), 9), 'k': 3}}, {{'d': round(abs(g[4] - f{k}), 9), 'k': 4}}]).k"
_rated("calibrate_quantile", consensus.link_quantiles, f"""SELECT {ITEM}, rater_id, rating, CAST(CASE rating WHEN 1 THEN t1 WHEN 2 THEN greatest(t1, t2) WHEN 3 THEN greatest(t1, t2, t3) ELSE greatest(t1, t2, t3, t4) END AS INT) AS calibrated FROM ratings JOIN (
    SELECT aspect, rater_id, {", ".join(f"{_near(k)} AS t{k}" for k in range(1, 5))} FROM (SELECT aspect, rater_id, {_F} FROM (SELECT aspect, rater_id, {COUNTS} FROM ratings GROUP BY ALL))
    JOIN (SELECT aspect, [f1, f2, f3, f4] AS g FROM (SELECT aspect, {_F} FROM (SELECT aspect, {COUNTS} FROM ratings GROUP BY ALL))) USING (aspect)) USING (aspect, rater_id)""")
LOO = f"SELECT aspect, rater_id, round(avg(abs(e)), 6) AS mae, round(avg(e * e), 6) AS mse, count(*) AS n_items FROM (SELECT aspect, rater_id, rating - s / n AS e FROM (SELECT *, sum(rating) OVER w - rating AS s, count(*) OVER w - 1 AS n FROM ratings WINDOW w AS (PARTITION BY {ITEM})) WHERE n > 0) GROUP BY 1, 2"
_rated("loo_scores", consensus.leave_one_out, LOO)
_rated("human_range", consensus.human_range, f"SELECT aspect, round(avg(mae), 5) AS mean_mae, round(stddev_pop(mae), 5) AS sd_mae, count(*) AS n_raters FROM ({LOO}) GROUP BY 1")
MAJORITY = f"(SELECT {ITEM}, CASE WHEN c1 = most THEN 1 WHEN c2 = most THEN 2 WHEN c3 = most THEN 3 ELSE 4 END AS vote FROM (SELECT *, greatest(c1, c2, c3, c4) AS most FROM (SELECT {ITEM}, {COUNTS} FROM ratings GROUP BY ALL)) WHERE n >= 2 AND CAST(c1 = most AS INT) + CAST(c2 = most AS INT) + CAST(c3 = most AS INT) + CAST(c4 = most AS INT) = 1)"
_rated("majority_vote", consensus.majority, f"SELECT * FROM {MAJORITY}")
_rated("majority_confusion", consensus.confusion, f"SELECT aspect, vote, rating, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY aspect, vote), 6) AS share FROM ratings JOIN {MAJORITY} USING ({ITEM}) GROUP BY 1, 2, 3")
_rated("level_distribution", evaluation.level_distribution, "SELECT aspect, rating, n, round(100.0 * n / sum(n) OVER (PARTITION BY aspect), 6) AS percent FROM (SELECT aspect, rating, count(r.aspect) AS n FROM (SELECT DISTINCT aspect FROM ratings) CROSS JOIN (VALUES (1), (2), (3), (4)) v(rating) LEFT JOIN ratings r USING (aspect, rating) GROUP BY 1, 2)")
WIDE = "(SELECT conv_id, utterance_id, avg(rating) FILTER (aspect = 'A') AS A, avg(rating) FILTER (aspect = 'N') AS N, avg(rating) FILTER (aspect = 'R') AS R FROM ratings GROUP BY 1, 2)"
_rho = lambda a, b: f"SELECT '{a}' AS first, '{b}' AS second, round((avg(x * y) - avg(x) * avg(y)) / nullif(sqrt(var_pop(x) * var_pop(y)), 0), 6) AS rho, count(*) AS n FROM (SELECT rank() OVER (ORDER BY {a}) + (count(*) OVER (PARTITION BY {a}) - 1) / 2 AS x, rank() OVER (ORDER BY {b}) + (count(*) OVER (PARTITION BY {b}) - 1) / 2 AS y FROM {WIDE} WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"
_rated("spearman_matrix", evaluation.spearman, " UNION ALL ".join(_rho(a, b) for a, b in (("A", "N"), ("A", "R"), ("N", "R"))))
_WAYS = {"min": "least(A, N, R)", "max": "greatest(A, N, R)", "mean": "(A + N + R) / 3", "median": "A + N + R - greatest(A, N, R) - least(A, N, R)", "geometric": "exp((ln(A) + ln(N) + ln(R)) / 3)", "harmonic": "3 / (1 / A + 1 / N + 1 / R)", "power2": "sqrt((A * A + N * N + R * R) / 3)", "softmax": "(A * exp(A) + N * exp(N) + R * exp(R)) / (exp(A) + exp(N) + exp(R))"}
_rated("combiner_grid", evaluation.combiner_grid, " UNION ALL ".join(f"SELECT '{k}' AS combiner, round(avg(abs({v} - A)), 6) AS mae, count(*) AS n FROM {WIDE} WHERE A IS NOT NULL AND N IS NOT NULL AND R IS NOT NULL" for k, v in _WAYS.items()))

MAE = f"SELECT model, context, aspect, round(avg(e), 6) AS mae, round(stddev_pop(e), 6) AS mae_sd, count(*) AS n_runs, CAST(floor(avg(n)) AS BIGINT) AS n_samples FROM (SELECT model, context, aspect, run, avg(abs(rating - y)) AS e, count(*) AS n FROM preds JOIN (SELECT {ITEM}, avg(rating) AS y FROM ratings GROUP BY ALL) USING ({ITEM}) GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3"
register("mae_by_context", lambda s, d: evaluation.mae_by_context(predictions(s, d), ratings(s, d)), with_views(MAE, "preds"))
register("model_ranking", lambda s, d: evaluation.best_by_aspect(predictions(s, d), ratings(s, d)), with_views(f"SELECT aspect, model, context, mae, row_number() OVER (PARTITION BY aspect ORDER BY mae, model, context) AS rank FROM ({MAE})", "preds"))
register("reference_mae", lambda s, d: evaluation.reference_mae(predictions(s, d)), with_views(f"SELECT model, context, aspect, round(avg(abs(rating - y)), 6) AS mae, count(*) AS n FROM preds JOIN (SELECT model, {ITEM}, avg(rating) AS y FROM preds WHERE context = 'full' GROUP BY ALL) USING (model, {ITEM}) WHERE context <> 'full' GROUP BY 1, 2, 3", "preds"))


def _said(name, operator, sql):
    register(name, lambda spark, sf: operator(utterances(spark, sf)), sql and with_views(sql, "utterances"))


TERMS = "(SELECT conv_id, idx, term, count(*) AS tf FROM (SELECT conv_id, idx, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS term FROM utterances) GROUP BY ALL)"
_said("tfidf_features", text.tfidf, f"""SELECT conv_id, idx, round(coalesce(a, 0), 6) AS tfidf_mean, round(coalesce(s, 0), 6) AS tfidf_sum, round(coalesce(m, 0), 6) AS tfidf_max, round(coalesce(i, 0), 6) AS idf_mean, round(coalesce(d, 0), 6) AS idf_median FROM utterances LEFT JOIN (
    SELECT conv_id, idx, avg(tf * idf) AS a, sum(tf * idf) AS s, max(tf * idf) AS m, avg(idf) AS i, median(idf) AS d FROM {TERMS} JOIN (
    SELECT conv_id, term, ln((1.0 + n) / (1.0 + df)) + 1 AS idf FROM (SELECT conv_id, term, count(*) AS df FROM {TERMS} GROUP BY 1, 2) JOIN (SELECT conv_id, count(*) AS n FROM utterances GROUP BY 1) USING (conv_id) WHERE df >= 2 AND df <= 0.95 * n) USING (conv_id, term) GROUP BY 1, 2) USING (conv_id, idx)""")
_said("novelty_features", text.novelty, f"""SELECT conv_id, idx, distinct_terms, novel, seen_through - novel AS seen_before, seen_through, round(coalesce(novel / nullif(distinct_terms, 0), 0), 6) AS novelty_ratio FROM (
    SELECT *, CAST(sum(novel) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) AS BIGINT) AS seen_through FROM (
    SELECT conv_id, idx, coalesce(distinct_terms, 0) AS distinct_terms, coalesce(novel, 0) AS novel FROM utterances LEFT JOIN (SELECT conv_id, idx, count(*) AS distinct_terms FROM {TERMS} GROUP BY 1, 2) USING (conv_id, idx)
    LEFT JOIN (SELECT conv_id, idx, count(*) AS novel FROM (SELECT conv_id, term, min(idx) AS idx FROM {TERMS} GROUP BY 1, 2) GROUP BY 1, 2) USING (conv_id, idx)))""")
_LINES = "role || ': ' || text"
_said("context_window", lambda u: text.context(u).select("conv_id", "idx", F.length("context").alias("n_chars"), F.md5("context").alias("digest")),
      f"SELECT conv_id, idx, length(context) AS n_chars, md5(context) AS digest FROM (SELECT conv_id, idx, coalesce(string_agg({_LINES}, chr(10)) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 'No Context') AS context FROM utterances)")
_said("context_modes", lambda u: text.context(u, None).select("conv_id", "idx", F.lit("all").alias("mode"), F.length("context").alias("n_chars"), F.md5("context").alias("digest")).unionByName(text.context(u, 0).select("conv_id", "idx", F.lit("none").alias("mode"), F.length("context").alias("n_chars"), F.md5("context").alias("digest"))),
      f"SELECT conv_id, idx, mode, length(context) AS n_chars, md5(context) AS digest FROM (SELECT conv_id, idx, 'all' AS mode, coalesce(string_agg({_LINES}, chr(10)) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 'No Context') AS context FROM utterances UNION ALL SELECT conv_id, idx, 'none', 'No Context' FROM utterances)")
SKIP = "coalesce(lower(trim(role)) IN ('mod', 'moderator', 'audience', 'host', 'unknown', 'system') OR n_words <= 3 OR (n_words <= 5 AND NOT regexp_matches(text, '[.!?]$')), false)"
_said("skip_rule", lambda u: text.skip_flags(u, (*text.MODERATORS, "system")), f"SELECT conv_id, idx, n_words, skip, max(CAST(NOT skip AS INT)) OVER (PARTITION BY conv_id ORDER BY idx ROWS UNBOUNDED PRECEDING) = 0 AS leading FROM (SELECT *, {SKIP} AS skip FROM (SELECT *, CAST(len(string_split(text, ' ')) AS INT) AS n_words FROM utterances))")
_said("reading_time", text.reading_time, r"SELECT conv_id, idx, CAST(floor(greatest(len(list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '')) / 238.0 * 60, 3.0)) AS BIGINT) AS seconds FROM utterances")
WORDS = "(SELECT conv_id, role, len(string_split(text, ' ')) AS w FROM utterances)"
_said("gini_speakers", text.gini, f"SELECT conv_id, round(coalesce(2.0 * sum(i * x) / nullif(count(*) * sum(x), 0) - (count(*) + 1) / count(*), 0), 6) AS gini, CAST(sum(x) AS BIGINT) AS words FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY x, role) AS i FROM (SELECT conv_id, role, sum(w) AS x FROM {WORDS} GROUP BY 1, 2)) GROUP BY 1")
_said("describe_corpus", text.describe, f"SELECT count(*) AS n_conversations, {', '.join(f'round(avg({c}), 6) AS {n}_mean, round(stddev_samp({c}), 6) AS {n}_sd' for c, n in (('u', 'utterances'), ('s', 'speakers'), ('w', 'words')))} FROM (SELECT conv_id, count(*) AS u, count(DISTINCT role) AS s, sum(w) AS w FROM {WORDS} GROUP BY 1)")

PREV = "(SELECT p.conv_id, p.idx, p.act, p.value, m.idx AS mod_idx, m.value AS mod_value, p.idx - m.idx AS lag FROM (SELECT * FROM acts WHERE NOT is_mod) p ASOF LEFT JOIN (SELECT * FROM acts WHERE is_mod) m ON p.conv_id = m.conv_id AND p.idx >= m.idx)"
register("asof_prev_act", lambda s, d: adjacency.previous_act(acts(s, d)), with_views(f"SELECT * FROM {PREV}", "acts"))
register("lag_curves", lambda s, d: adjacency.lag_curves(acts(s, d)), with_views(f"SELECT act, lag, round(avg(value), 6) AS mean_value, round(CASE WHEN count(*) > 1 THEN stddev_samp(value) / sqrt(count(*)) END, 6) AS sem, count(*) AS n FROM {PREV} WHERE lag BETWEEN 1 AND 5 GROUP BY 1, 2", "acts"))
register("act_lift", lambda s, d: adjacency.act_lift(acts(s, d)), with_views(f"SELECT act, round(a - b, 6) AS lift, round((a - b) / nullif(sqrt(va / nullif(na, 0) + vb / nullif(nb, 0)), 0), 5) AS welch_t, na AS n_near, nb AS n_other FROM (SELECT act, avg(value) FILTER (near) AS a, avg(value) FILTER (NOT near) AS b, var_samp(value) FILTER (near) AS va, var_samp(value) FILTER (NOT near) AS vb, count(value) FILTER (near) AS na, count(value) FILTER (NOT near) AS nb FROM (SELECT act, value, coalesce(lag <= 5, false) AS near FROM {PREV}) GROUP BY 1)", "acts"))


def _starts(spark, sf):
    """Where three runs start segments, from whole-number arithmetic on the turns."""
    runs = F.explode(F.array(*map(F.lit, (3, 4, 5)))).alias("every")
    return utterances(spark, sf).select("conv_id", "idx", runs).where("idx > 0 and idx % every = 0").select("conv_id", "idx")


def _turns(spark, sf):
    return utterances(spark, sf).groupBy("conv_id").agg(F.count("*").alias("n"))


VOTES = "(SELECT conv_id, idx + d AS idx, round(sum(w) / 3, 6) AS score FROM (SELECT * FROM (SELECT conv_id, idx FROM utterances, (VALUES (3), (4), (5)) v(every) WHERE idx > 0 AND idx % every = 0), (VALUES (-1, 0.5), (0, 1.0), (1, 0.5)) s(d, w)) JOIN (SELECT conv_id, count(*) AS n FROM utterances GROUP BY 1) USING (conv_id) WHERE idx + d >= 0 AND idx + d < n - 1 GROUP BY 1, 2)"
register("segment_votes", lambda s, d: segments.votes(_starts(s, d), 3, _turns(s, d)), with_views(f"SELECT conv_id, idx, CAST(score AS DOUBLE) AS score FROM {VOTES}", "utterances"))
register("segment_boundaries", lambda s, d: segments.pick_boundaries(segments.votes(_starts(s, d), 3, _turns(s, d)), _turns(s, d)))

INTEGRATED = "(SELECT doc_id, aspect, label_value, 'human_individual' AS label_source FROM labels UNPIVOT (label_value FOR aspect IN (quality, toxic)) UNION ALL SELECT doc_id, NULL, NULL, 'unlabeled' FROM documents ANTI JOIN labels USING (doc_id)) LEFT JOIN (SELECT doc_id, lang, source FROM documents) USING (doc_id)"
register("integrated_labels", lambda s, d: release.integrated(table(s, d, "documents"), table(s, d, "labels")), f"SELECT * FROM {INTEGRATED}")
register("label_source_counts", lambda s, d: release.source_counts(table(s, d, "documents"), table(s, d, "labels")), f"SELECT label_source, lang, count(*) AS n FROM {INTEGRATED} GROUP BY 1, 2")
register("unlabeled_anti", lambda s, d: table(s, d, "documents").join(table(s, d, "labels"), "doc_id", "left_anti").select("doc_id", "lang"), "SELECT doc_id, lang FROM documents ANTI JOIN labels USING (doc_id)")
register("latest_per_user", lambda s, d: release.latest_per_user(table(s, d, "events")), "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS rn FROM events) WHERE rn = 1")
register("stale_assignments", lambda s, d: release.stale(table(s, d, "events")), "SELECT user_id, CAST(floor(epoch(now - ts)) AS BIGINT) AS idle_seconds FROM (SELECT user_id, max(ts) AS ts FROM events GROUP BY 1), (SELECT max(ts) AS now FROM events) WHERE now - ts > INTERVAL 2 HOURS")
register("vector_topk", lambda s, d: release.vector_top_k(table(s, d, "embeddings")), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, m.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 5) AS score
    FROM embeddings q JOIN embeddings m USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> m.vec_id)) WHERE rank <= 5""")


def _updates(spark, sf):
    return table(spark, sf, "events").selectExpr("user_id AS conv_id", "event_id AS pos", "nullif(event_id % 7, 0) AS target", "CASE event_id % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'NONE' END AS action")


register("memory_resolve", lambda s, d: release.resolve_updates(_updates(s, d)), "SELECT conv_id, pos, target, action FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, target, action ORDER BY pos DESC) AS rn FROM (SELECT user_id AS conv_id, event_id AS pos, nullif(event_id % 7, 0) AS target, CASE event_id % 4 WHEN 0 THEN 'ADD' WHEN 1 THEN 'UPDATE' WHEN 2 THEN 'NONE' END AS action FROM events)) WHERE action IS DISTINCT FROM 'UPDATE' OR (rn = 1 AND target IS NOT NULL)")
