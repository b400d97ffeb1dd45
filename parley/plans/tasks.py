"""Queries over annotation tasks, episodes, stored answers and memory targets, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.functions import checks
from parley.operators import episodes, phrases, release, tasks, text, validation
from parley.operators.consensus import majority
from parley.plans.catalog import ITEM, MAJORITY
from parley.plans.features import _scores
from parley.registry import register
from parley.sources.tables import predictions, ratings, table, utterances, with_views

_ROLES = (*text.MODERATORS, "system")
_IN_ROLES = f"({', '.join(repr(r) for r in _ROLES)})"


def _said(spark, sf):
    return utterances(spark, sf).selectExpr("conv_id", "idx", "concat(role, idx % 3) AS speaker", "role", "text")


def _segments(spark, sf):
    return utterances(spark, sf).groupBy("conv_id", F.expr("idx div 4").alias("segment_id")).agg(F.min("idx").alias("start"), (F.max("idx") + 1).alias("end"), F.min_by("text", "idx").alias("summary"))


_words = lambda t: f"len(list_filter(regexp_split_to_array({t}, '\\s+'), lambda w: w <> ''))"
_secs = lambda t: f"CAST(floor(greatest({_words(t)} / 238.0 * 60, 3)) AS BIGINT)"
ASSEMBLED = f"""(WITH u AS (SELECT conv_id, idx, role || (idx % 3) AS speaker, role, text, len(string_split(text, ' ')) AS n, {_secs('text')} AS secs FROM utterances),
    s AS (SELECT conv_id, idx // 4 AS segment_id, min(idx) AS start, max(idx) + 1 AS stop, {_secs('min_by(text, idx)')} AS summary_seconds FROM u GROUP BY 1, 2),
    f AS (SELECT conv_id, segment_id, idx, speaker, role, n, secs, coalesce(lower(trim(role)) IN {_IN_ROLES} OR n <= 3 OR (n <= 5 AND NOT regexp_matches(text, '[.!?]$')), false) AS skip FROM u JOIN s USING (conv_id) WHERE idx >= start AND idx < stop),
    g AS (SELECT *, bool_and(skip) OVER (PARTITION BY conv_id, segment_id ORDER BY idx) AS head FROM f),
    t AS (SELECT conv_id, segment_id, count(*) FILTER (NOT head) AS n_utterances, count(*) FILTER (NOT skip) AS n_valid, round(count(*) FILTER (skip AND NOT head) / nullif(count(*) FILTER (NOT head), 0), 6) AS skipped_utterances, round(coalesce(sum(n) FILTER (skip AND NOT head), 0) / nullif(sum(n) FILTER (NOT head), 0), 6) AS skipped_tokens,
        count(DISTINCT CASE WHEN lower(trim(role)) NOT IN {_IN_ROLES} THEN speaker END) AS n_participants, CAST(coalesce(sum(secs) FILTER (NOT head), 0) AS BIGINT) AS utterance_seconds, count(*) FILTER (head) AS moved FROM g GROUP BY 1, 2),
    a AS (SELECT * EXCLUDE (start, stop, moved), start + moved AS start FROM s JOIN t USING (conv_id, segment_id)),
    l AS (SELECT a.conv_id, segment_id, u.idx, 360 - utterance_seconds - summary_seconds AS room, speaker || ' (' || role || '): ' || text AS line FROM a JOIN u ON u.conv_id = a.conv_id AND u.idx >= a.start - 5 AND u.idx < a.start),
    h AS (SELECT *, {_secs("split_part(line, ':', 2)")} AS secs, row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY idx DESC) AS rk FROM l),
    k AS (SELECT conv_id, segment_id, CAST(sum(secs) AS BIGINT) AS history_seconds, string_agg(line, '<br><br>' ORDER BY idx) AS history FROM (SELECT *, sum(secs) OVER (PARTITION BY conv_id, segment_id ORDER BY idx DESC) AS spent FROM h) WHERE rk = 1 OR room - spent > 0 GROUP BY 1, 2)
    SELECT a.*, coalesce(history_seconds, 0) AS history_seconds, md5(coalesce(history, '')) AS history, utterance_seconds + summary_seconds + coalesce(history_seconds, 0) AS total_seconds FROM a LEFT JOIN k USING (conv_id, segment_id))"""


def _assembled(spark, sf):
    return tasks.assemble(_said(spark, sf), _segments(spark, sf), 5, _ROLES).withColumn("history", F.md5("history"))


def _quality(spark, sf):
    rated = ratings(spark, sf).selectExpr("conv_id", "utterance_id div 4 AS segment_id", "aspect", "rating")
    scored = rated.groupBy("conv_id", "segment_id").agg(F.round(F.avg("rating"), 6).alias("summary_score"), F.min("rating").cast("double").alias("no_summary"), F.round(F.max("rating") / F.lit(4.0), 6).alias("confidence"))
    return tasks.quality(_assembled(spark, sf), rated, scored, ["A", "N", "R"])


_SPREAD = ", ".join(f"avg(rating) FILTER (aspect = '{a}') AS {a}m, stddev_pop(rating) FILTER (aspect = '{a}') AS {a}s" for a in "ANR")
register("assembled_tasks", _assembled, with_views(f"SELECT * FROM {ASSEMBLED}", "utterances"))
register("task_quality", _quality, with_views(f"""SELECT conv_id, segment_id, skipped_tokens, skipped_utterances, n_valid, n_utterances, n_participants, total_seconds, abs(total_seconds - 360) AS seconds_off, abs(n_valid - 7) AS utterances_off, round(summary_score - no_summary, 6) AS context_benefit, summary_score, confidence, round(Am, 6) AS A_mean, round(A_s, 6) AS A_std, round(Nm, 6) AS N_mean, round(Ns, 6) AS N_std, round(Rm, 6) AS R_mean, round(Rs, 6) AS R_std,
    round((Am + Nm + Rm) / 3, 6) AS overall_mean, round((A_s + Ns + Rs) / 3, 6) AS overall_std, round(sqrt(((Am - (Am + Nm + Rm) / 3) ** 2 + (Nm - (Am + Nm + Rm) / 3) ** 2 + (Rm - (Am + Nm + Rm) / 3) ** 2) / 3), 6) AS spread_of_means
    FROM {ASSEMBLED} LEFT JOIN (SELECT conv_id, utterance_id // 4 AS segment_id, round(avg(rating), 6) AS summary_score, CAST(min(rating) AS DOUBLE) AS no_summary, round(max(rating) / 4.0, 6) AS confidence, {_SPREAD.replace(' As,', ' A_s,')} FROM ratings GROUP BY 1, 2) USING (conv_id, segment_id)""", "ratings", "utterances"))

_told = "SELECT conv_id, idx, text AS immediate_prior, CASE WHEN idx % 3 > 0 THEN role END AS summary, role || '/' || text AS full_prior, CASE WHEN idx % 2 > 0 THEN '- ' || role END AS memory FROM {u}"
_near = "'Immediate prior dialogue:\n' || immediate_prior || '\n\n'"
_blocks = {"full": "'Full Prior Dialogue:\n' || full_prior || '\n\n'", "summary": f"'Prior dialogue summary:\n' || coalesce(summary, '') || '\n\n' || {_near}", "memory": f"'Prior dialogue memory:\n' || coalesce(memory, '') || '\n\n' || {_near}", "short_prior": f"'No other prior knowledge.\n' || {_near}", "no_knowledge": "'No other prior knowledge.\nNo prior dialogue:\n'"}
register("knowledge", lambda s, d: tasks.knowledge(s.sql(_told.format(u="{t}"), t=utterances(s, d)), ["conv_id", "idx"]).withColumn("knowledge", F.md5("knowledge")),
         with_views(f"SELECT * FROM (WITH k AS ({_told.format(u='utterances')}) " + " UNION ALL ".join(f"SELECT conv_id, idx, '{m}' AS method, md5({b}) AS knowledge FROM k" for m, b in _blocks.items()) + ")", "utterances"))

_ORDER = [f"m{i}/{c}" for i in range(3) for c in ("full", "short")]


def _summary_scores(spark, sf):
    seg = "CAST(utterance_id div 20 AS BIGINT) AS segment_id"
    votes = majority(ratings(spark, sf)).selectExpr("conv_id", seg, "utterance_id AS idx", "aspect", "vote AS rating")
    said = predictions(spark, sf).where("run = 0 and not (model = 'm2' and context = 'short' and utterance_id % 20 = 3)").selectExpr("conv_id", seg, "utterance_id AS idx", "aspect", "concat_ws('/', model, context) AS variant", "rating")
    due = votes.select("conv_id", "idx").distinct()
    return tasks.summary_scores(said.join(due, ["conv_id", "idx"], "left_semi"), votes, ["conv_id", "segment_id"], _ORDER)


_V = f"(SELECT conv_id, utterance_id // 20 AS segment_id, utterance_id AS idx, aspect, vote FROM {MAJORITY})"
_C = f"(SELECT conv_id, utterance_id // 20 AS segment_id, utterance_id AS idx, aspect, model || '/' || context AS variant, rating FROM preds WHERE run = 0 AND NOT (model = 'm2' AND context = 'short' AND utterance_id % 20 = 3) AND (conv_id, utterance_id) IN (SELECT (conv_id, utterance_id) FROM {MAJORITY}))"
register("summary_scores", _summary_scores, with_views(f"""SELECT conv_id, segment_id, variant, score, score IS NOT NULL AND row_number() OVER (PARTITION BY conv_id, segment_id ORDER BY score DESC NULLS LAST, list_position([{', '.join(map(repr, _ORDER))}], variant)) = 1 AS best
    FROM (SELECT conv_id, segment_id, variant, CASE WHEN own = due AND k.n = ratings_due THEN kappa_nominal ELSE 0.0 END AS score FROM (SELECT conv_id, segment_id, variant, count(DISTINCT idx) AS own FROM {_C} GROUP BY 1, 2, 3) JOIN (SELECT conv_id, segment_id, count(DISTINCT idx) AS due, count(*) AS ratings_due FROM {_V} GROUP BY 1, 2) USING (conv_id, segment_id)
    LEFT JOIN {_scores(f'SELECT conv_id, segment_id, variant, vote AS x, rating AS y FROM {_V} JOIN {_C} USING (conv_id, segment_id, idx, aspect)', 'conv_id, segment_id, variant')} k USING (conv_id, segment_id, variant))""", "ratings", "preds"))
register("segmentation_report", lambda s, d: tasks.segmentation_report(table(s, d, "events").selectExpr("user_id AS conv_id", "event_id % 50 AS start", "event_id % 50 + event_id % 7 AS end", "value / 500 AS confidence")), "SELECT user_id AS conv_id, count(*) AS n_segments, round(avg(value / 500), 6) AS mean_confidence, round(avg(event_id % 7), 6) AS mean_length FROM events GROUP BY 1")

# Answers: how long, how far and of what each one is follows from its event's number.
_ANSWERS = {
    "summary": """'```json\\n{"summary": "' || repeat('word ', CAST(event_id % 450 AS INT)) || '"}\\n```'""",
    "rated": """CASE WHEN event_id % 7 = 0 THEN '{"utterance_index": 1}' WHEN event_id % 7 = 1 THEN '[{"utterance_index": 1, "tone": 2}]' ELSE '[{"utterance_index": 1, "novelty": 2}, {"utterance_index": ' || (event_id % 3 + 1) || '}]' END""",
    "claims": """'[{"id": "a' || (event_id % 4) || '", "novelty": 1}, {"id": "b"}]'""",
    "segments": """CASE WHEN event_id % 9 = 0 THEN 'none' ELSE '[{"utterances_interval": [0, 2]}, {"utterances_interval": [3, ' || (event_id % 8) || ']}]' END""",
}


def _answer_checks(spark, sf):
    rows = table(spark, sf, "events").selectExpr("event_id", *(f"{e} AS {n}" for n, e in _ANSWERS.items()))
    number = lambda c: F.col("event_id") % c
    return rows.select("event_id", checks.valid_summary(F.col("summary")).alias("summary"), checks.valid_ratings(F.col("rated"), F.lit(1), number(5) + 1).alias("rated"), checks.valid_claims(F.col("claims"), F.array(F.lit("b"), F.concat(F.lit("a"), (number(3)).cast("string")))).alias("claims"), checks.valid_segments(F.col("segments"), number(6)).alias("segments"))


register("answer_checks", _answer_checks, "SELECT event_id, event_id % 450 BETWEEN 210 AND 350 AS summary, event_id % 7 > 1 AND event_id % 3 = event_id % 5 AS rated, event_id % 4 = event_id % 3 AS claims, event_id % 9 > 0 AND event_id % 8 BETWEEN event_id % 6 - 1 AND event_id % 6 AS segments FROM events")
register("id_parts", lambda s, d: table(s, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 3 = 0 THEN concat('insq_', lang, '_', doc_id) WHEN doc_id % 3 = 1 THEN concat(lang, '_x') ELSE lang END AS id", "concat(' ', source, '\n', lang, '\t') AS rater", "text").select("doc_id", *checks.id_parts(F.col("id")), checks.aliases(F.col("id")).alias("a"), checks.rater_name(F.col("rater")).alias("rater"), F.col("text")).withColumn("length", checks.length_series(table(s, d, "documents"))).select("doc_id", "conv_id", "utt_index", F.col("a")[1].alias("alias"), "rater", "length"),
         "SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'insq_' || lang WHEN 1 THEN lang ELSE '' END AS conv_id, CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id AS DOUBLE) END AS utt_index, CASE doc_id % 3 WHEN 0 THEN lang || '_' || doc_id WHEN 1 THEN 'insq_' || lang || '_x' ELSE 'insq_' || lang END AS alias, lower(source || ' ' || lang) AS rater, CAST(coalesce(length(text), 0) AS DOUBLE) AS length FROM documents")

_NAMES = ["Ann ", "ann", "BEN\tB"]
_wide = lambda q: "SELECT l_suppkey % 5 AS episode, l_orderkey AS utterance_id, " + ", ".join(f"max(CASE WHEN l_linenumber = {i + 1} THEN l_returnflag || l_linestatus END) AS {q}{n}{q}" for i, n in enumerate(_NAMES)) + " FROM {lines} GROUP BY 1, 2"
_long = lambda s, d: episodes.wide_to_long(s.sql(_wide("`").replace("{lines}", "{t}"), t=table(s, d, "lineitem")), _NAMES)
LONG = f"""(SELECT episode, utterance_id, episode || '||' || utterance_id AS item_id, unnest(['ann', 'ben b']) AS annotator, unnest([coalesce("Ann ", "ann_"), ben]) AS label FROM ({_wide('').replace('AS Ann ,', 'AS "Ann ",').replace('AS ann,', 'AS ann_,').replace(f'AS {_NAMES[2]}', 'AS ben').format(lines='lineitem')}))"""
register("episode_long", _long, f"SELECT * FROM {LONG} WHERE label IS NOT NULL")
register("rater_matrix", lambda s, d: episodes.matrix(_long(s, d).withColumn("label", F.expr("CASE WHEN label LIKE 'A%' THEN 'none' ELSE CAST(length(label) + episode AS STRING) END")), ["ben b", "ann"]), f"SELECT item_id, max(v) FILTER (annotator = 'ann') AS ann, max(v) FILTER (annotator = 'ben b') AS \"ben b\" FROM (SELECT item_id, annotator, CASE WHEN label NOT LIKE 'A%' THEN CAST(2 + episode AS DOUBLE) END AS v FROM {LONG} WHERE label IS NOT NULL) GROUP BY 1")
_stacked = "SELECT user_id % 9 AS episode, CASE WHEN user_id % 9 < 3 AND event_id % 2 = 0 THEN 'c' || (user_id % 9) || event_type END AS conv_id, CASE WHEN user_id % 9 < 6 THEN 'x_' || event_type || '_' || (event_id % 40) ELSE 'e' || event_id END AS utterance_id, event_id FROM {events}"
register("stacked_episodes", lambda s, d: episodes.stack(s.sql(_stacked.replace("{events}", "{t}"), t=table(s, d, "events"))), f"""WITH e AS ({_stacked.format(events='events')}), s AS (SELECT episode, regexp_extract(utterance_id, '^(.*)_', 1) AS start, count(*) AS n FROM e WHERE contains(utterance_id, '_') GROUP BY 1, 2), b AS (SELECT episode, arg_min(start, (-n, start)) AS start FROM s GROUP BY 1),
    k AS (SELECT episode, coalesce(min(conv_id), any_value(start)) AS conv_id FROM e LEFT JOIN b USING (episode) GROUP BY 1), m AS (SELECT episode, printf('epi_%03d', row_number() OVER (ORDER BY episode)) AS number FROM k WHERE conv_id IS NULL)
    SELECT episode, event_id, coalesce(k.conv_id, number) AS conv_id, CASE WHEN count(*) OVER (PARTITION BY utterance_id) > 1 THEN utterance_id || '::' || coalesce(k.conv_id, number) ELSE utterance_id END AS utterance_id FROM e JOIN k USING (episode) LEFT JOIN m USING (episode)""")
register("act_report", lambda s, d: episodes.act_report(table(s, d, "documents").selectExpr("doc_id", "CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS corpus"), ["EN", "de"]), "SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN upper(lang) ELSE lang END AS corpus FROM documents WHERE lower(lang) IN ('en', 'de')")
register("vote_listing", lambda s, d: episodes.vote_listing(ratings(s, d), majority(ratings(s, d))), with_views(f"SELECT {ITEM}, votes, vote FROM (SELECT {ITEM}, string_agg(rater_id || ': ' || rating, '; ' ORDER BY rater_id) AS votes FROM ratings GROUP BY ALL) LEFT JOIN {MAJORITY} USING ({ITEM})", "ratings"))

_debate = "SELECT conv_id, idx, role || (idx % 3) AS speaker, CASE WHEN role = 'system' THEN 'mod' WHEN conv_id % 3 = 0 THEN role WHEN idx % 2 = 0 THEN 'for' ELSE 'against' END AS role FROM {u}"
register("conversation_meta", lambda s, d: episodes.conversation_meta(s.sql(_debate.replace("{u}", "{t}"), t=utterances(s, d))).select("conv_id", "moderator", F.array_join(F.transform("speakers", lambda x: F.concat_ws("=", x["speaker"], x["stance"])), "|").alias("speakers"), F.array_join("options", "|").alias("options")),
         with_views(f"""SELECT * FROM (WITH d AS ({_debate.format(u='utterances')}), f AS (SELECT conv_id, speaker, min(idx) AS i, arg_min(role, idx) AS stance FROM d GROUP BY 1, 2), s AS (SELECT conv_id, string_agg(speaker || '=' || stance, '|' ORDER BY i) AS speakers, list(speaker ORDER BY i) AS names FROM f GROUP BY 1),
    m AS (SELECT conv_id, coalesce(arg_max(speaker, idx) FILTER (role = 'mod'), '') AS moderator, list(speaker || '- ' || role ORDER BY role = 'against', idx) FILTER (role IN ('for', 'against')) AS sides FROM d GROUP BY 1)
    SELECT conv_id, moderator, speakers, '0 (Unknown)|1 (Self)|2 (Everyone)|3 (Audience)|' || array_to_string(list_transform(coalesce(sides, names), lambda n, i: (i + 3) || ' (' || n || ')'), '|') AS options FROM m JOIN s USING (conv_id))""", "utterances"))
register("entity_features", lambda s, d: episodes.entity_features(utterances(s, d).select("conv_id", "idx", F.size(F.split("text", " ")).alias("n_tokens")), utterances(s, d).select("conv_id", "idx", F.explode(F.regexp_extract_all("text", F.lit("([A-Z][a-z]+)"), 1)).alias("entity"))),
         with_views("""SELECT * FROM (WITH e AS (SELECT conv_id, idx, unnest(regexp_extract_all(text, '[A-Z][a-z]+')) AS entity FROM utterances), f AS (SELECT conv_id, entity, min(idx) AS idx FROM e GROUP BY 1, 2), o AS (SELECT conv_id, idx, count(*) AS n_entities, count(DISTINCT entity) AS n_distinct FROM e GROUP BY 1, 2), n AS (SELECT conv_id, idx, count(*) AS novel FROM f GROUP BY 1, 2),
    j AS (SELECT u.conv_id, u.idx, len(string_split(text, ' ')) AS n_tokens, coalesce(n_entities, 0) AS n_entities, coalesce(n_distinct, 0) AS n_distinct, coalesce(novel, 0) AS novel FROM utterances u LEFT JOIN o USING (conv_id, idx) LEFT JOIN n USING (conv_id, idx)), k AS (SELECT *, CAST(sum(novel) OVER (PARTITION BY conv_id ORDER BY idx) AS BIGINT) AS known_through FROM j)
    SELECT conv_id, idx, n_entities, n_distinct, novel, known_through - novel AS known_before, known_through, round(novel / greatest(1, n_distinct), 6) AS novelty_ratio, round(novel / greatest(1, n_tokens), 6) AS novelty_density FROM k)""", "utterances"))
# Marks stand after the end of a sentence; without SQL, tested against a plain loop.
register("watermarks", lambda s, d: episodes.watermarks(utterances(s, d), ["the", "of", "and", "to", "in", "a", "an"], 1, 2))

# Memories by claim: the digest of a number, so that only equal ones are alike.
_MEMORY = "SELECT o_orderkey {div} 50 AS conv_id, 'm' || o_orderkey AS id, 's' || (o_custkey % 3) AS speaker, 'all' AS target_speaker, md5(CAST(o_orderkey % 37 AS {text})) AS claim, CAST(o_orderkey AS {text}) AS turn_id FROM {orders}"
_WANTED = "SELECT l_orderkey {div} 50 AS conv_id, l_orderkey * 8 + l_linenumber AS pos, 's' || (l_linenumber % 3) AS speaker, ' ' || md5(CAST(l_orderkey % 41 AS {text})) AS claim FROM {lines}"


#: Lines that a task gets where conversations lie together, some 100 MB with all that is made of them.
_LINES = 200_000


def _dealt(spark, sf):
    """The keys of lines and of orders, a conversation's together, and in how many partitions; what is made of them stays there."""
    lines, orders = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber"), table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = max(spark.sparkContext.defaultParallelism, -(-lines.count() // _LINES))
    return lines.repartition(parts, F.expr("l_orderkey div 50")), orders.repartition(parts, F.expr("o_orderkey div 50")), parts


def _target_lookup(spark, sf):
    lines, orders, parts = _dealt(spark, sf)
    wanted = spark.sql(_WANTED.format(text="STRING", div="div", lines="{t}"), t=lines).groupBy("conv_id", "pos").agg(F.min("speaker").alias("speaker"), F.min("claim").alias("claim"))
    memories = spark.sql(_MEMORY.format(text="STRING", div="div", orders="{t}"), t=orders)
    return validation.resolve_targets(wanted, memories, parts).select("conv_id", "pos", "found.id", "found.turn_id", "step")


register("target_lookup", _target_lookup, f"""WITH m AS ({_MEMORY.format(text='VARCHAR', div='//', orders='orders')}), w AS (SELECT conv_id, pos, min(speaker) AS speaker, trim(min(claim)) AS claim FROM ({_WANTED.format(text='VARCHAR', div='//', lines='lineitem')}) GROUP BY 1, 2),
    o AS (SELECT conv_id, claim, speaker, any_value(id) AS id, any_value(turn_id) AS turn FROM m GROUP BY 1, 2, 3 HAVING count(*) = 1), a AS (SELECT conv_id, claim, any_value(id) AS id, any_value(turn_id) AS turn FROM m GROUP BY 1, 2 HAVING count(*) = 1), e AS (SELECT conv_id, claim, min(id) AS id, arg_min(turn_id, id) AS turn FROM m GROUP BY 1, 2)
    SELECT conv_id, pos, coalesce(o.id, a.id, e.id) AS id, coalesce(o.turn, a.turn, e.turn) AS turn_id, CASE WHEN o.id IS NOT NULL THEN 'speaker' WHEN a.id IS NOT NULL THEN 'claim' ELSE 'likeness' END AS step FROM w JOIN e USING (conv_id, claim) LEFT JOIN o USING (conv_id, claim, speaker) LEFT JOIN a USING (conv_id, claim)""")


def _memory_validation(spark, sf):
    lines, orders, parts = _dealt(spark, sf)
    keys = lines.selectExpr("l_orderkey div 50 AS conv_id", "l_orderkey * 8 + l_linenumber AS pos", "l_orderkey", "l_linenumber").dropDuplicates(["conv_id", "pos"])
    updates = keys.selectExpr("conv_id", "pos", "CASE l_linenumber % 4 WHEN 0 THEN 'add' WHEN 1 THEN 'UPD' WHEN 2 THEN 'NONE' ELSE 'drop' END AS action", "element_at(array('equivalent', 'Neutral', 'contradiction', 'odd'), CAST(l_orderkey % 4 AS INT) + 1) AS relation",
        "named_struct('speaker', 's' || (l_linenumber % 3), 'target_speaker', 'all', 'claim', md5(CAST(l_orderkey % 41 AS STRING)), 'turn_id', CAST(l_linenumber AS STRING)) AS source", "CASE WHEN l_orderkey % 3 = 0 THEN named_struct('id', 'm' || (l_orderkey + l_orderkey % 2 * 1000000), 'speaker', 's' || (l_orderkey % 3), 'target_speaker', 'all', 'claim', 'x', 'turn_id', '1') END AS target")
    memories = spark.sql(_MEMORY.format(text="STRING", div="div", orders="{t}"), t=orders)
    out = validation.validate(updates, memories, parts=parts)
    return out.select("conv_id", "pos", "action", "relation", F.col("target.id").alias("target_id"), F.array_join("errors", ",").alias("errors"), F.array_join("warnings", ",").alias("warnings"), "kept")


register("memory_validation", _memory_validation)
register("briefing", lambda s, d: release.unique_hits(release.vector_top_k(table(s, d, "embeddings"), 3)), """SELECT vec_id, max(score) AS score, count(*) AS n_queries FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, m.vec_id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(m.embedding AS DOUBLE[])), 5) AS score
    FROM embeddings q JOIN embeddings m USING (label) WHERE q.vec_id % 20 = 0 AND q.vec_id <> m.vec_id)) WHERE rank <= 3 GROUP BY 1""")


def _shared_phrases(spark, sf):
    """Each utterance against the one before it; capitalised words are phrases."""
    said = utterances(spark, sf).select("conv_id", "idx", episodes.capitalised(F.col("text")).alias("own"))
    before = said.select("conv_id", (F.col("idx") + 1).alias("idx"), F.col("own").alias("before"))
    return said.join(before, ["conv_id", "idx"]).select("conv_id", "idx", F.array_join(phrases.shared_phrases(F.col("own"), F.col("before")), "|").alias("phrases"))


register("shared_phrases", _shared_phrases, with_views(r"""SELECT conv_id, idx, array_to_string(list_sort(list_distinct(list_filter(list_transform(t, lambda w: list_filter(list_sort(list_distinct(c)), lambda x: contains(w, x) OR len(list_intersect(string_split(w, ''), string_split(x, ''))) > 0)[1]), lambda x: x IS NOT NULL))), '|') AS phrases
    FROM (SELECT u.conv_id, u.idx, regexp_extract_all(u.text, '\b([A-Z][a-z]+)', 1) AS t, regexp_extract_all(v.text, '\b([A-Z][a-z]+)', 1) AS c FROM utterances u JOIN utterances v ON v.conv_id = u.conv_id AND v.idx + 1 = u.idx)""", "utterances"))
