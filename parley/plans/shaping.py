"""Queries that shape tables, release labels and follow moderators' acts, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import adjacency, comparison, evaluation, ranks, shaping, text
from parley.operators.consensus import consensus_labels, majority
from parley.plans.catalog import ITEM, MAJORITY, PREV, _labels
from parley.plans.reports import _PAIRS
from parley.registry import register
from parley.sources.tables import acts, predictions, ratings, table, utterances, with_views

_NAMES = "CASE WHEN lower(trim(a)) IN ('scope', 'implication_scope', 'implication scope', 'imsc') THEN 'Scope' WHEN lower(trim(a)) IN ('informativeness', 'info', 'cig') THEN 'CIG' WHEN lower(trim(a)) IN ('novelty', 'novo') THEN 'Novelty' WHEN lower(trim(a)) IN ('relevance', 'relv') THEN 'Relevance' ELSE trim(a) END"
_A = "list_element([' Info', 'NOVO', 'relv ', 'imsc', ' Other '], CAST(event_id % 5 AS INT) + 1)"
register("aspect_names", lambda s, d: table(s, d, "events").select("event_id", shaping.aspect_name(F.expr("array(' Info', 'NOVO', 'relv ', 'imsc', ' Other ')[CAST(event_id % 5 AS INT)]")).alias("aspect")), f"SELECT event_id, {_NAMES} AS aspect FROM (SELECT event_id, {_A} AS a FROM events)")
register("checked_levels", lambda s, d: shaping.checked_levels(table(s, d, "events").selectExpr("event_id", "CASE WHEN event_id % 6 = 0 THEN 'none' ELSE CAST(event_id % 4 + 1 AS STRING) END AS rating")), "SELECT event_id, CAST(event_id % 4 + 1 AS INT) AS rating FROM events WHERE event_id % 6 <> 0")
register("unit_flags", lambda s, d: table(s, d, "events").select("event_id", shaping.unit_flag(F.expr("CASE WHEN event_id % 3 = 0 THEN 'x' ELSE CAST(value / 100 - 1 AS STRING) END")).alias("flag")).select("event_id", F.round("flag", 6).alias("flag")), "SELECT event_id, round(CASE WHEN event_id % 3 = 0 THEN 0.0 ELSE greatest(0.0, least(1.0, value / 100 - 1)) END, 6) AS flag FROM events")
register("corpus_filter", lambda s, d: shaping.preferred_first(shaping.of_corpora(table(s, d, "documents"), "lang", table(s, d, "documents").groupBy("lang").count().where("count > 20"), "text"), "lang", "doc_id"), "SELECT lang, doc_id, source, n_chars FROM documents SEMI JOIN (SELECT lang FROM documents GROUP BY 1 HAVING count(*) > 20) USING (lang)")
register("long_sessions", lambda s, d: shaping.long_sessions(table(s, d, "events"), "user_id", 20).select("user_id", "event_id"), "SELECT user_id, event_id FROM events SEMI JOIN (SELECT user_id FROM events GROUP BY 1 HAVING count(*) > 20) USING (user_id)")
register("renumbered", lambda s, d: shaping.renumbered(utterances(s, d)), with_views("SELECT conv_id, idx, CAST(row_number() OVER (PARTITION BY conv_id ORDER BY idx) - 1 AS INT) AS number FROM utterances WHERE trim(text) <> ''", "utterances"))

# Tasks: an order is a task of a customer's conversation, its lines are target utterances; every third has no corpus.
_CONV = "'c' || (o_custkey % 7) || '_' || o_custkey"
_CORPUS = "CASE WHEN o_orderkey % 3 > 0 THEN 'c' || (o_custkey % 7) || 'x' END"
TASKS = f"SELECT o_orderkey AS task_id, {_CONV} AS conv_id, {_CORPUS} AS corpus_id, o_orderkey % 5 AS segment_id FROM orders"


def _tasks(spark, sf):
    lines = table(spark, sf, "lineitem").selectExpr("l_orderkey AS task_id", "struct(l_linenumber % 4 AS id, l_linenumber AS index, l_linestatus AS speaker, l_returnflag AS text) AS u")
    held = lines.groupBy("task_id").agg(F.collect_list("u").alias("utterances"))
    orders = table(spark, sf, "orders").selectExpr("o_orderkey AS task_id", f"{_CONV} AS conv_id", f"{_CORPUS} AS corpus_id", "o_orderkey % 5 AS segment_id")
    return orders.join(held, "task_id")


def _annotations(spark, sf):
    rated = table(spark, sf, "lineitem").selectExpr("l_orderkey", "l_linenumber", "l_suppkey", "struct(l_linenumber AS id, map('info', CAST(l_linenumber % 4 + 1 AS INT), 'NOVO', 1, 'noise', 9) AS labels) AS u")
    # The base task of some annotations is not known, so that the own one counts; of others neither is.
    return rated.groupBy(F.col("l_orderkey").alias("o"), F.col("l_suppkey").alias("annotator_id")).agg(F.collect_list("u").alias("utterances")).selectExpr("annotator_id", "utterances", "'z' || (o % 3) || '_' || o AS conv_id", "CASE WHEN o % 2 = 0 THEN o ELSE -1 END AS base_task_id", "CASE WHEN o % 5 = 0 THEN -o ELSE o END AS task_id")


CONTEXTS = f"SELECT corpus, conv_id, segment_id, task_id, utterance_id, u.i AS utterance_index, u.s AS speaker, u.t AS text FROM (SELECT coalesce(corpus_id, split_part(conv_id, '_', 1)) AS corpus, conv_id, segment_id, task_id, CAST(l_linenumber % 4 AS VARCHAR) AS utterance_id, min({{'i': l_linenumber, 's': l_linestatus, 't': l_returnflag}}) AS u FROM ({TASKS}) JOIN lineitem ON task_id = l_orderkey GROUP BY 1, 2, 3, 4, 5)"
ANNOTATED = f"""SELECT coalesce(t.corpus_id, 'z' || (l_orderkey % 3)) AS corpus, 'z' || (l_orderkey % 3) || '_' || l_orderkey AS conv_id, t.segment_id, CASE WHEN l_orderkey % 5 = 0 THEN -l_orderkey ELSE l_orderkey END AS task_id, l_suppkey AS source_id, CAST(l_linenumber AS VARCHAR) AS utterance_id, k.aspect, CASE k.aspect WHEN 'CIG' THEN CAST(l_linenumber % 4 + 1 AS INT) ELSE 1 END AS label_value, 'human_individual' AS label_source
    FROM lineitem CROSS JOIN (VALUES ('CIG'), ('Novelty')) k(aspect) LEFT JOIN ({TASKS}) t ON t.task_id = l_orderkey AND (l_orderkey % 2 = 0 OR l_orderkey % 5 <> 0)"""
register("task_contexts", lambda s, d: shaping.task_contexts(_tasks(s, d)), CONTEXTS)
register("annotation_rows", lambda s, d: shaping.annotation_rows(_annotations(s, d), _tasks(s, d), ["info", "NOVO"]), ANNOTATED)


def _released(spark, sf):
    own = table(spark, sf, "lineitem").selectExpr("concat('c', l_suppkey % 20) AS corpus", "l_orderkey AS conv_id", "CAST(l_linenumber AS STRING) AS utterance_id", "l_returnflag AS aspect", "CAST(l_linenumber AS DOUBLE) AS label_value", "'human_individual' AS label_source", "CAST(l_suppkey AS STRING) AS source_id")
    agreed = consensus_labels(ratings(spark, sf), 0.5).selectExpr("concat('c', conv_id) AS corpus", "conv_id", "CAST(utterance_id AS STRING) AS utterance_id", "aspect", "CAST(y_hard AS DOUBLE) AS label_value", "'human_consensus' AS label_source", "CAST(NULL AS STRING) AS source_id", "n_raters")
    contexts = utterances(spark, sf).selectExpr("conv_id", "CAST(idx AS STRING) AS utterance_id", "CAST(idx AS INT) AS utterance_index", "md5(text) AS text")
    return shaping.released(own, agreed, contexts)


register("released_labels", _released, with_views(f"""SELECT * FROM (SELECT 'c' || (l_suppkey % 20) AS corpus, l_orderkey AS conv_id, CAST(l_linenumber AS VARCHAR) AS utterance_id, l_returnflag AS aspect, CAST(l_linenumber AS DOUBLE) AS label_value, 'human_individual' AS label_source, CAST(l_suppkey AS VARCHAR) AS source_id, CAST(NULL AS BIGINT) AS n_raters FROM lineitem
    UNION ALL SELECT 'c' || conv_id, conv_id, CAST(utterance_id AS VARCHAR), aspect, CAST(y_hard AS DOUBLE), 'human_consensus', NULL, n_raters FROM ({_labels('ratings', 0.5)})) LEFT JOIN (SELECT conv_id, CAST(idx AS VARCHAR) AS utterance_id, CAST(idx AS INT) AS utterance_index, md5(text) AS text FROM utterances) USING (conv_id, utterance_id)""", "ratings", "utterances"))

register("rated_breakdown", lambda s, d: shaping.rated_breakdown(ratings(s, d), majority(ratings(s, d))), with_views(f"SELECT conv_id, utterance_id, count(DISTINCT rater_id) AS n_annotators, round(avg(1 - abs(rating - vote) / (SELECT CAST(max(vote) - min(vote) AS DOUBLE) FROM {MAJORITY})), 6) AS adjusted_accuracy FROM ratings JOIN {MAJORITY} USING ({ITEM}) GROUP BY 1, 2", "ratings"))
register("participants", lambda s, d: shaping.participants(utterances(s, d), (*text.MODERATORS, "system")), with_views("SELECT conv_id, count(DISTINCT CASE WHEN lower(trim(role)) NOT IN ('mod', 'moderator', 'audience', 'host', 'unknown', 'system') THEN lower(trim(role)) END) AS n_participants FROM utterances GROUP BY 1", "utterances"))
register("latency_summary", lambda s, d: shaping.latency_summary(table(s, d, "events").selectExpr("event_type", "CASE WHEN event_id % 4 > 0 THEN value END AS value"), "event_type", "value"), "SELECT event_type, round(avg(value), 6) AS mean, round(coalesce(stddev_samp(value), 0), 6) AS std, count(*) AS n FROM events WHERE event_id % 4 > 0 AND value IS NOT NULL GROUP BY 1")
register("entropy_features", lambda s, d: table(s, d, "embeddings").select("vec_id", F.when(F.col("vec_id") % 5 > 0, F.to_json("embedding")).otherwise("none").alias("stored")).select("vec_id", shaping.number_list(F.col("stored")).alias("v")).select("vec_id", F.size("v").alias("n_values"), F.round(shaping.top_quartile_mean(F.col("v")), 5).alias("top_quartile")),
         "SELECT vec_id, CASE WHEN vec_id % 5 > 0 THEN CAST(len(embedding) AS INT) ELSE 0 END AS n_values, CASE WHEN vec_id % 5 > 0 THEN round(list_avg(list_sort(CAST(embedding AS DOUBLE[]), 'DESC')[1:greatest(1, CAST(ceil(len(embedding) * 0.25) AS INT))]), 5) ELSE 0 END AS top_quartile FROM embeddings")
_TIMES = {0: "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss'Z'\")", 1: "date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\")", 2: "concat(date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss\"), '+02:00')", 3: "'soon'"}
register("utc_times", lambda s, d: table(s, d, "events").withColumn("ts", F.date_trunc("second", "ts")).selectExpr("event_id", "CASE event_id % 4 " + " ".join(f"WHEN {k} THEN {v}" for k, v in _TIMES.items()) + " END AS stored").select("event_id", F.unix_timestamp(shaping.utc_time(F.col("stored"))).alias("seconds")),
         "SELECT event_id, CASE WHEN event_id % 4 < 3 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - CASE WHEN event_id % 4 = 2 THEN 7200 ELSE 0 END END AS seconds FROM events")
register("numbered_context", lambda s, d: shaping.numbered_context(utterances(s, d)).select("conv_id", "idx", F.length("context").alias("n_chars"), F.md5("context").alias("digest")), with_views("SELECT conv_id, idx, length(c) AS n_chars, md5(c) AS digest FROM (SELECT conv_id, idx, coalesce(string_agg(idx || '. ' || role || ': ' || text, chr(10)) OVER (PARTITION BY conv_id ORDER BY idx ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 'No Context') AS c FROM utterances)", "utterances"))
register("without_mark", lambda s, d: shaping.without_mark(utterances(s, d), "text", utterances(s, d).where("idx = 0 and conv_id % 3 > 0").selectExpr("conv_id", "substring_index(text, ' ', 1) AS mark"), "conv_id").select("conv_id", "idx", F.length("text").alias("n_chars"), F.md5("text").alias("digest")), with_views("SELECT conv_id, idx, length(t) AS n_chars, md5(t) AS digest FROM (SELECT u.conv_id, u.idx, CASE WHEN coalesce(mark, '') <> '' THEN replace(text, mark, '') ELSE text END AS t FROM utterances u LEFT JOIN (SELECT conv_id, split_part(text, ' ', 1) AS mark FROM utterances WHERE idx = 0 AND conv_id % 3 > 0) USING (conv_id))", "utterances"))

# Three turns of a user's are an utterance, spoken by a moderator if any of them is an error; every turn is a sentence.
_ACTS = ["click", "error", "signup"]


def _turns(spark, sf):
    rows = acts(spark, sf).withColumn("utt", F.expr("CAST((idx - 1) div 3 AS BIGINT)"))
    turns = rows.groupBy("conv_id", "utt").agg(F.max("is_mod").alias("is_mod"), F.avg("value").alias("value"))
    return turns, rows.where("value > 100").select("conv_id", "utt", "act")


_TURN = "t AS (SELECT conv_id, CAST((idx - 1) // 3 AS BIGINT) AS utt, bool_or(is_mod) AS is_mod, avg(value) AS value FROM acts GROUP BY 1, 2), m AS (SELECT conv_id, utt, " + ", ".join(f"max(CAST(coalesce(act = '{a}', false) AS INT)) AS {a}" for a in _ACTS) + " FROM (SELECT * FROM t WHERE is_mod) LEFT JOIN (SELECT conv_id, CAST((idx - 1) // 3 AS BIGINT) AS utt, act FROM acts WHERE value > 100) USING (conv_id, utt) GROUP BY 1, 2)"
_FOLLOWED = f"p AS (SELECT t.conv_id, t.utt, t.value, t.utt - m.utt AS prev_distance, {', '.join(f'm.{a} AS prev_{a}' for a in _ACTS)} FROM (SELECT * FROM t WHERE NOT is_mod) t ASOF LEFT JOIN m ON t.conv_id = m.conv_id AND t.utt >= m.utt)"
_acted = lambda select, *ctes: with_views(f"SELECT * FROM (WITH {', '.join(ctes)} {select})", "acts")
_flags = lambda s, d: shaping.flag_sequence(*_turns(s, d), _ACTS)
_previous = lambda s, d: shaping.previous_flags(_turns(s, d)[0], _flags(s, d), _ACTS)
register("act_sequence", _flags, _acted("SELECT * FROM m", _TURN))
register("previous_flags", lambda s, d: _previous(s, d).withColumn("value", F.round("value", 6)), _acted("SELECT * REPLACE (round(value, 6) AS value) FROM p", _TURN, _FOLLOWED))
_LEVELS = " UNION ALL ".join(f"SELECT '{a}' AS act, greatest(0, least(1, coalesce(prev_{a}, 0))) AS level, value FROM p WHERE value IS NOT NULL" for a in _ACTS)
register("flag_lift", lambda s, d: shaping.flag_lift(_previous(s, d), _ACTS).drop("p", "marked"), _acted(f"""SELECT act, level, round(m, 6) AS mean, round(sd / sqrt(n), 6) AS sem, n, round(m - sum(m * n) OVER w / sum(n) OVER w, 6) AS lift_overall, round(m - CASE level WHEN 1 THEN any_value(m) FILTER (level = 0) OVER w ELSE any_value(m) FILTER (level = 1) OVER w END, 6) AS lift_other
    FROM (SELECT act, CAST(level AS INT) AS level, avg(value) AS m, stddev_samp(value) AS sd, count(*) AS n FROM ({_LEVELS}) GROUP BY 1, 2) WINDOW w AS (PARTITION BY act)""", _TURN, _FOLLOWED))
register("flag_lift_marked", lambda s, d: shaping.flag_lift(_previous(s, d), _ACTS))
register("curve_peaks", lambda s, d: shaping.peaks(adjacency.lag_curves(acts(s, d)), 3, 5), with_views(f"SELECT act, max(mean_value) AS peak, CAST(row_number() OVER (ORDER BY max(mean_value) DESC, act) AS INT) AS rank FROM (SELECT act, lag, round(avg(value), 6) AS mean_value, count(*) AS n FROM {PREV} WHERE lag BETWEEN 1 AND 5 GROUP BY 1, 2) WHERE n >= 5 GROUP BY 1 QUALIFY row_number() OVER (ORDER BY max(mean_value) DESC, act) <= 3", "acts"))
register("strongest_correlations", lambda s, d: comparison.by_strength(ranks.correlations(evaluation.aspect_pairs(ratings(s, d)), "first", "second").select("first", "second", "spearman")), with_views(f"""SELECT first, second, spearman, CAST(row_number() OVER (ORDER BY abs(spearman) DESC, first, second) AS INT) AS rank FROM (SELECT first, second, round(corr(rx, ry), 6) AS spearman
    FROM (SELECT *, rank() OVER (PARTITION BY first, second ORDER BY x) + (count(*) OVER (PARTITION BY first, second, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY first, second ORDER BY y) + (count(*) OVER (PARTITION BY first, second, y) - 1) / 2 AS ry FROM {_PAIRS} WHERE x IS NOT NULL AND y IS NOT NULL) GROUP BY 1, 2 HAVING count(*) >= 10)""", "ratings"))
_SECONDS = "CAST(floor(greatest(len(list_filter(regexp_split_to_array(split_part(text, ':', 1), '\\s+'), lambda x: x <> '')) / 238.0 * 60, 3.0)) AS BIGINT)"
register("prior_history", lambda s, d: text.prior_history(utterances(s, d), 60), with_views(f"""SELECT u.conv_id, u.idx, CAST(count(b.idx) AS INT) AS n_shown, min(b.idx) AS first_shown, CAST(coalesce(sum(b.seconds), 0) AS BIGINT) AS seconds FROM utterances u LEFT JOIN (
    SELECT conv_id, idx, place, seconds FROM (SELECT *, bool_and(back = 1 OR spent < 60) OVER (PARTITION BY conv_id, place ORDER BY back) AS shown FROM (SELECT a.conv_id, a.idx AS place, b.idx, b.seconds, row_number() OVER w AS back, sum(b.seconds) OVER w AS spent FROM utterances a JOIN (SELECT conv_id, idx, {_SECONDS} AS seconds FROM utterances) b ON a.conv_id = b.conv_id AND b.idx < a.idx AND b.idx >= a.idx - 5 WINDOW w AS (PARTITION BY a.conv_id, a.idx ORDER BY b.idx DESC))) WHERE shown
    ) b ON u.conv_id = b.conv_id AND u.idx = b.place GROUP BY 1, 2""", "utterances"))


def _answers(spark, sf):
    """One object for odd utterances (run 0 alone), a list of all runs' objects for even ones; two are no JSON."""
    runs = predictions(spark, sf).groupBy("model", "context", "conv_id", "utterance_id", "run").agg(F.map_from_entries(F.collect_list(F.struct("aspect", "rating"))).alias("levels"))
    all_ = runs.groupBy("model", "context", "conv_id", "utterance_id").agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("run"), F.to_json("levels").alias("j")))), lambda x: x["j"]).alias("j"))
    answer = F.when(F.col("utterance_id") < 2, "none").when(F.col("utterance_id") % 2 == 1, F.element_at("j", 1)).otherwise(F.concat(F.lit("["), F.array_join("j", ", "), F.lit("]")))
    return all_.withColumn("answer", answer).drop("j")


register("flatten_answers", lambda s, d: shaping.flatten_answers(_answers(s, d), ["A", "R"], ("m2",), ("full",)), with_views("SELECT model, context, conv_id, utterance_id, CAST(run AS INT) AS run, aspect, rating FROM preds WHERE model <> 'm2' AND context = 'full' AND aspect IN ('A', 'R') AND utterance_id >= 2 AND (utterance_id % 2 = 0 OR run = 0)", "preds"))
register("run_means", lambda s, d: shaping.run_means(predictions(s, d), "m1", "full"), with_views(f"SELECT {ITEM}, round(avg(rating), 6) AS rating, count(*) AS n_runs FROM preds WHERE model = 'm1' AND context = 'full' GROUP BY ALL", "preds"))
register("first_turns", lambda s, d: shaping.first_by(utterances(s, d), "conv_id", "idx", "role", "text").select("conv_id", "role", F.md5("text").alias("digest")), with_views("SELECT conv_id, arg_min(role, idx) AS role, md5(arg_min(text, idx)) AS digest FROM utterances GROUP BY 1", "utterances"))
register("stacked_groups", lambda s, d: shaping.stacked(table(s, d, "lineitem").selectExpr("l_orderkey AS o", "l_linenumber AS l", "l_suppkey AS s", "l_quantity AS h_x", "l_tax AS n_x", "l_extendedprice AS h_y", "l_discount AS n_y"), ["o", "l", "s"], {"x": {"h": "h_x", "n": "n_x"}, "y": {"h": "h_y", "n": "n_y"}}, "model"), "SELECT l_orderkey AS o, l_linenumber AS l, l_suppkey AS s, 'x' AS model, l_quantity AS h, l_tax AS n FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, l_suppkey, 'y', l_extendedprice, l_discount FROM lineitem")
register("ratings_with_vote", lambda s, d: shaping.with_vote(ratings(s, d), majority(ratings(s, d))), with_views(f"SELECT {ITEM}, rater_id, rating, vote FROM ratings LEFT JOIN {MAJORITY} USING ({ITEM})", "ratings"))
register("vote_confusion", lambda s, d: shaping.vote_confusion(predictions(s, d), majority(ratings(s, d))), with_views(f"SELECT model, vote, rating, count(*) AS n FROM preds JOIN {MAJORITY} USING ({ITEM}) GROUP BY 1, 2, 3", "preds"))
