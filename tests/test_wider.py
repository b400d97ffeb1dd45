"""Corpora as files, lifts with their probabilities, and the check of coverage."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import comparison, shaping
from parley.operators.metrics import t_probability
from parley.sources import files


def test_corpus_to_transcripts(spark, tmp_path):
    lines = [
        {"id": "u10", "conversation_id": "7", "speaker": "ann", "timestamp": 2, "text": "--“So”… it’s—fine", "meta": {"segment": 1, "speakertype": "for", "nontext": {"a": 1}, "other": [1]}},
        {"id": "u9", "conversation_id": "7", "speaker": "bob", "timestamp": 2, "text": "first of two at once", "meta": {"segment": 0, "speakertype": "mod"}},
        {"id": "u1", "conversation_id": "7", "speaker": "bob", "timestamp": 1, "text": "", "meta": {}},
        {"id": "u2", "root": "8", "user": "eve", "timestamp": None, "text": "---", "meta": None, "reply-to": None},
        {"id": "u3", "conversation_id": "9", "speaker": "x", "timestamp": 5, "text": "not asked for", "meta": {}},
    ]
    (tmp_path / "utterances.jsonl").write_text("\n".join(json.dumps(x) for x in lines))
    (tmp_path / "conversations.json").write_text(json.dumps({"7": {"meta": {"title": "A motion", "x": 1}}, "9": {"title": "Old"}}, indent=1))
    got = files.read_corpus(spark, f"file://{tmp_path}", ["7", "8"]).orderBy("conversation_id", "utterance_index").collect()
    assert [tuple(r) for r in got] == [
        ("A motion", "7", "0", "u9", 0, "bob", "mod", None, "first of two at once", -1),
        ("A motion", "7", "1", "u10", 1, "ann", "for", '{"a": 1}', "\"So\"... it's-fine", -1),
        (None, "8", None, "u2", 0, "eve", None, None, "", -1),
    ]
    every = files.read_corpus(spark, f"file://{tmp_path}")
    assert {r.title for r in every.collect()} == {"A motion", None, "Old"}
    plan = every.select("conversation_id")._jdf.queryExecution().executedPlan().toString()
    assert "nontext" not in plan.split("ReadSchema")[1]  # columns that are not asked for are not parsed
    files.write_csv(every, f"file://{tmp_path}/out")
    back = files.read_transcripts(spark, f"file://{tmp_path}/out/conversation_id=7", "title string, phase string, utterance_id string, utterance_index int, utterance_speaker string, role string, nontext string, utterance_text string, segment int")
    assert sorted((r.utterance_index, r.utterance_text) for r in back.collect()) == [(0, "first of two at once"), (1, "\"So\"... it's-fine")]


def test_lift_by_level(spark):
    rng = np.random.default_rng(1)
    rows = [(i % 5, i, float(v), None if i < 20 else int(f), 1) for i, (v, f) in enumerate(zip(rng.normal(size=120), rng.integers(0, 2, size=120), strict=True))] + [(9, 1, None, 1, 1)]
    previous = spark.createDataFrame(rows, "conv_id long, utt long, value double, prev_ask int, prev_always int")
    got = {(r.act, r.level): r for r in shaping.flag_lift(previous, ["ask", "always"]).collect()}
    assert set(got) == {("ask", 0), ("ask", 1), ("always", 1)}
    on, off = (np.array([v for _, _, v, f, _ in rows if v is not None and (f or 0) == k]) for k in (1, 0))
    both = np.concatenate((on, off))
    a, b = on.var(ddof=1) / len(on), off.var(ddof=1) / len(off)
    t, freedom = (on.mean() - off.mean()) / math.sqrt(a + b), (a + b) ** 2 / (a**2 / (len(on) - 1) + b**2 / (len(off) - 1))
    r, s = got["ask", 1], got["ask", 0]
    assert (r.n, s.n) == (len(on), len(off)) and r.p == pytest.approx(t_probability(t, freedom), abs=1e-9) and s.p is None
    assert (r.mean, r.sem) == (pytest.approx(on.mean(), abs=1e-6), pytest.approx(math.sqrt(a), abs=1e-6))
    assert r.lift_overall == pytest.approx(on.mean() - both.mean(), abs=1e-6) and s.lift_other == pytest.approx(off.mean() - on.mean(), abs=1e-6)
    assert r.marked == f"{on.mean() - both.mean():.3f}" + "*" * (t_probability(t, freedom) < 0.05)
    assert got["always", 1].lift_other is None and got["always", 1].p is None


def test_coverage_is_checked(spark):
    ratings = spark.createDataFrame([(1, u, "A", 1, 2) for u in range(3)], "conv_id long, utterance_id long, aspect string, rater_id long, rating int")
    full = [(1, u, "A", "m", "c", 0, 3) for u in range(3)]
    schema = "conv_id long, utterance_id long, aspect string, model string, context string, run long, rating int"
    assert comparison.checked_coverage(spark.createDataFrame(full, schema), ratings).count() == 3
    with pytest.raises(ValueError, match="1 of m/c/1"):
        comparison.checked_coverage(spark.createDataFrame([*full, *((1, u, "A", "m", "c", 1, 1 + (u > 0)) for u in range(3))], schema), ratings)


def test_frequent_and_missing_base_tasks(spark):
    # Tasks 1 and 7 are the base of many annotations, 7 is not known; others have none.
    found = [(i, [1, 7, None, 2][i % 4], 3 if i % 3 else 4, f"z_{i}") for i in range(200)]
    annotations = spark.createDataFrame([(str(i), b, t, c, [("u", {"info": 2})]) for i, b, t, c in found], "annotator_id string, base_task_id long, task_id long, conv_id string, utterances array<struct<id:string,labels:map<string,int>>>")
    tasks = spark.createDataFrame([(1, "one", 10), (2, "", 20), (3, "three", 30)], "task_id long, corpus_id string, segment_id long")
    known = {1: ("one", 10), 2: ("z", 20), 3: ("three", 30)}
    want = sorted((str(i), *(known.get(b) or known.get(t) or ("z", None))) for i, b, t, c in found)
    for frequent in (5, 1000):
        rows = shaping.annotation_rows(annotations, tasks, ["info"], frequent)
        assert sorted((r.source_id, r.corpus, r.segment_id) for r in rows.collect()) == want


def test_frequent_keys_do_not_share_a_task(spark):
    rows = spark.range(4000).selectExpr("id", "IF(id % 2 = 0, -1, id) AS k")
    held = spark.range(50).selectExpr("id AS k", "id AS v")
    for name, value in (("spark.sql.autoBroadcastJoinThreshold", "-1"), ("spark.sql.adaptive.enabled", "false")):
        spark.conf.set(name, value)
    try:
        met = shaping._looked_up(rows, held, "k", "v", F.xxhash64("id"), 100)
        sizes = [r[1] for r in met.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        for name in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled"):
            spark.conf.unset(name)
    assert sum(sizes) == 4000 and max(sizes) < 1200
