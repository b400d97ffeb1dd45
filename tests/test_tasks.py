"""Tasks, episodes, checks and files against hand-worked cases and plain loops."""

import json
import random
import re
import string
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from parley.functions import checks
from parley.operators import episodes, tasks
from parley.sources import files


def test_answers_are_read_once(spark):
    rows = spark.createDataFrame([('[{"utterance_index": 1, "id": "a"}]',)], "a string")
    for check in (checks.valid_ratings(F.col("a"), F.lit(1), F.lit(1)), checks.valid_claims(F.col("a"), F.array(F.lit("a")))):
        plan = rows.select(check.alias("ok"))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 1


def test_a_task_drops_its_skipped_head_and_shows_what_fits(spark):
    long = " ".join(["word"] * 20) + "."
    said = [(1, 0, "Ann", "guest", long), (1, 1, "Mo", "mod", "Welcome to all of you here today."), (1, 2, "Ben", "guest", long), (1, 3, "Ann", "guest", "yes"), (1, 4, "Ben", "guest", long)]
    utterances = spark.createDataFrame(said, "conv_id long, idx long, speaker string, role string, text string")
    segments = spark.createDataFrame([(1, 0, 1, 5, None), (1, 1, 3, 4, " ".join(["w"] * 2000)), (2, 0, 0, 0, "")], "conv_id long, segment_id long, start long, end long, summary string")
    got = {(r.conv_id, r.segment_id): r for r in tasks.assemble(utterances, segments).collect()}
    r = got[1, 0]
    assert (r.start, r.n_utterances, r.n_valid, r.skipped_utterances, r.skipped_tokens, r.n_participants) == (2, 3, 2, round(1 / 3, 6), round(1 / 41, 6), 2)
    assert (r.utterance_seconds, r.summary_seconds, r.history_seconds, r.total_seconds) == (13, 3, 8, 24)
    assert r.history == f"Ann (guest): {long}<br><br>Mo (mod): Welcome to all of you here today."
    r = got[1, 1]  # the summary leaves no time, so that only the nearest line is shown
    assert (r.start, r.n_utterances, r.skipped_tokens, r.history) == (4, 0, None, "Ann (guest): yes")
    assert (got[2, 0].n_utterances, got[2, 0].history, got[2, 0].total_seconds) == (0, "", 3)


def test_best_summary_is_the_first_of_equal_ones(spark):
    reference = spark.createDataFrame([(1, i, "a", v) for i, v in enumerate((1, 2, 3, 4))], "seg long, idx long, aspect string, rating int")
    rated = {"x": (1, 2, 3, 4), "y": (1, 2, 3, 4), "z": (4, 3, 2, 1), "short": (1, 2, 3)}
    rows = [(1, i, "a", n, v) for n, values in rated.items() for i, v in enumerate(values)]
    got = {r.variant: (r.score, r.best) for r in tasks.summary_scores(spark.createDataFrame(rows, "seg long, idx long, aspect string, variant string, rating int"), reference, ["seg"], ["y", "x", "z", "short"]).collect()}
    assert got == {"y": (1.0, True), "x": (1.0, False), "z": (round(-1 / 3, 6), False), "short": (0.0, False)}


def test_answers_that_cannot_be_read_are_not_valid(spark):
    rows = spark.createDataFrame([(a,) for a in (None, "", "[]", "{", "[1]", '[{"id": "a"}]', '[{"utterance_index": "x"}]')], "a string")
    got = rows.select(checks.valid_summary(F.col("a")), checks.valid_ratings(F.col("a"), F.lit(1), F.lit(1)), checks.valid_claims(F.col("a"), F.array(F.lit("a"))), checks.valid_segments(F.col("a"), F.lit(3))).collect()
    assert [tuple(r) for r in got] == [(False, False, i == 5, False) for i in range(7)]
    with pytest.raises(KeyError):
        checks.length_series(rows)


def plain_mark(texts, stops, least, times):
    """The most frequent start of runs of capitalised words, word after word."""
    counts = {}
    for sentence in re.split(r"(?<!\w\.\w.)(?<![A-Z][a-z]\.)(?<=\.|\?|\!)\s", " ".join(texts)):
        run, n, before = [], 0, ""
        for token in sentence.split(" "):
            word = token.strip().strip(string.punctuation + "“”")
            kind = "mark" if not word else "capital" if word[0].isupper() else "low"
            if kind == "low" and run and not (before[:1].isupper() and word in stops):
                run, n = [], 0
                continue
            if run:
                run.append(token)
                n += kind != "mark"
            elif kind == "capital" and (word.lower() not in stops or word == "The"):
                run, n = [token], 1
            if run and n >= least:
                counts[" ".join(run)] = counts.get(" ".join(run), 0) + 1
            before = word
    if not counts:
        return None, 0
    top = max(counts.values())
    best = min((-len(k), k) for k, v in counts.items() if v == top)[1]
    return (best if top >= times else None), top


def test_watermarks_match_a_plain_loop(spark):
    rng = random.Random(5)
    words = ["Open", "To", "the", "The", "Debate", "of", "-", "ideas", "U.S.", "we", "Mr.", "say", "end.", "Why?"]
    convs = {c: [" ".join(rng.choice(words) for _ in range(rng.randint(0, 25))) for _ in range(6)] for c in range(12)}
    convs[99] = ["no capital here", ""]
    rows = spark.createDataFrame([(c, i, t) for c, ts in convs.items() for i, t in enumerate(ts)], "conv_id long, idx long, text string")
    got = {r.conv_id: (r.mark, r.n) for r in episodes.watermarks(rows, ["the", "of", "to", "we"], 2, 3).collect()}
    assert got == {c: plain_mark(ts, {"the", "of", "to", "we"}, 2, 3) for c, ts in convs.items()}


def test_files_in_and_out(spark, tmp_path):
    lines = lambda p: [json.loads(x) for f in Path(p).glob("*.json") for x in f.read_text().splitlines()]
    files.write_idf_maps(spark.createDataFrame([("c1", "b", 1.5), ("c1", "a", 1.0), ("c2", "a", 2.0)], "conversation_id string, term string, idf double"), f"{tmp_path}/idf")
    assert sorted(lines(f"{tmp_path}/idf"), key=str) == [{"conversation_id": "c1", "idf": {"a": 1.0, "b": 1.5}}, {"conversation_id": "c2", "idf": {"a": 2.0}}]
    labels = spark.createDataFrame([("a",), ("a",), (None,)], "label_source string")
    files.write_summary(labels, f"{tmp_path}/sum")
    assert lines(f"{tmp_path}/sum") == [{"rows": 3, "label_source_counts": {"a": 2, "null": 1}}]
    rows = spark.createDataFrame([("c1", 'say "x",\nthen'), ("c2", "y")], "conversation_id string, text string")
    files.write_csv(rows, f"{tmp_path}/csv")
    assert sorted(r.text for r in spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(f"{tmp_path}/csv").collect()) == ['say "x",\nthen', "y"]
    rows.write.parquet(f"{tmp_path}/snap")
    found = files.read_snapshot(spark, f"{tmp_path}/snap", conversation_id="c2")
    assert [r.text for r in found.collect()] == ["y"]
    assert "EqualNullSafe(conversation_id,c2)" in found._jdf.queryExecution().toString()
    vectors = [{"conversation_id": "insq_7", "memory_id": "1", "memory": "m", "embedding": [1.0]}, {"conversation_id": "7", "memory_id": "2", "memory": "m", "embedding": [2.0]}, {"conversation_id": "8", "memory_id": "3", "memory": "n", "embedding": [3.0]}, {"conversation_id": "7", "memory_id": "4", "memory": "o", "embedding": []}]
    (tmp_path / "v.jsonl").write_text("\n".join(map(json.dumps, vectors)))
    assert [tuple(r) for r in files.read_vectors(spark, f"{tmp_path}/v.jsonl", ["7", "insq_7"]).collect()] == [("m", [2.0])]
    (tmp_path / "acts").mkdir()
    (tmp_path / "acts" / "EGI_12.csv").write_text("id,prob\nu1,1\n")
    (tmp_path / "acts" / "EGI_13.csv").write_text("id,prob\nu2,0\n")
    assert [(r.id, r.conversation_id) for r in files.read_acts(spark, f"{tmp_path}/acts", "id string, prob int", ["12"]).collect()] == [("u1", "12")]
    metas = spark.createDataFrame([("7", "insq_7_meta.json", [("1", "m", [1.0]), ("2", "n", None)])], "conversation_id string, file_name string, prior_memory array<struct<id:string,memory:string,embedding:array<double>>>")
    assert [tuple(r) for r in files.memory_vectors(metas).collect()] == [("insq_7", "1", "m", [1.0])]
