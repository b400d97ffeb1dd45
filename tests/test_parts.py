"""Parts that no SQL covers: test probabilities, greedy merging, files, streams, edge cases."""

import json
import random

import pytest
from pyspark.sql import functions as F

from parley.functions import scalars
from parley.operators import features, memory, metrics, nested
from parley.sources import files
from parley.streaming.novelty import novelty_stream


def test_probabilities_match_tables():
    assert metrics.t_probability(2.228139, 10) == pytest.approx(0.05, abs=1e-6)
    assert metrics.t_probability(1.0, 1) == pytest.approx(0.5, abs=1e-9)
    assert metrics.t_probability(-12.706205, 1) == pytest.approx(0.05, abs=1e-6)
    assert metrics.f_probability(4.964603, 1, 10) == pytest.approx(0.05, abs=1e-6)
    assert metrics.f_probability(3.0, 2, 2) == pytest.approx(0.25, abs=1e-9)
    assert metrics.t_probability(None, 3) is None and metrics.t_probability(1.0, 0) is None


def test_scores_of_constant_and_odd_levels(spark):
    rows = [("same", 2, 2), ("same", 2, 2), ("gap", 1, 1), ("gap", 2, 4), ("gap", 4, 4), ("gap", None, 3), ("gap", 9, 1)]
    got = {r.g: r for r in metrics.scores(spark.createDataFrame(rows, "g string, x int, y int"), "g").collect()}
    assert (got["same"].kappa_fixed, got["same"].kappa_present, got["same"].n) == (1.0, None, 2)
    assert got["gap"].n == 3 and got["gap"].kappa_present != got["gap"].kappa_fixed


def test_merged_segments_match_a_plain_loop(spark):
    rng = random.Random(3)
    rows = [(c, s, 2 * s, 2 * s + 2, rng.randrange(90), rng.randrange(1, 4)) for c in range(12) for s in range(rng.randrange(1, 15))]
    least, most, turns = 60, 120, 6
    off = lambda w: least - w if w < least else w - most if w > most else 0
    want = []
    for c in range(12):
        cur, k = None, 0
        for _, _, start, end, w, n in (r for r in rows if r[0] == c):
            if cur is not None and off(cur[2] + w) < off(cur[2]) and cur[3] + n <= turns:
                cur = (cur[0], end, cur[2] + w, cur[3] + n)
                continue
            if cur is not None:
                want.append((c, k, *cur))
                k += 1
            cur = (start, end, w, n)
        want.append((c, k, *cur))
    df = spark.createDataFrame(rows, "conv_id long, segment long, start long, end long, words long, n_turns long")
    assert sorted(map(tuple, features.merge_segments(df, least, most, turns).collect())) == want


def test_flattening_drops_what_is_unusable(spark):
    said = [(7, {"a": "3", "N": "9", "Z": "2", "R": None}), (8, None)]
    docs = spark.createDataFrame([(1, "x", said), (1, " ", said), (2, "y", None)], "conv_id long, rater_id string, utterances array<struct<utterance_id: long, labels: map<string, string>>>")
    assert [tuple(r) for r in nested.flatten_annotations(docs, ["A", "N", "R"]).collect()] == [(1, 7, "A", "x", 3)]


def test_replay_ignores_updates_of_nothing(spark):
    rows = [(1, 1, "ADD", None, "a"), (1, 2, "UPDATE", 1, "b"), (1, 3, "UPDATE", 9, "c"), (1, 4, "NONE", 1, "d"), (1, 5, "ADD", None, "e")]
    got = memory.replay(spark.createDataFrame(rows, "conv_id long, pos long, action string, target long, claim string"))
    assert sorted(map(tuple, got.collect())) == [(1, 1, "b", 2, 1), (1, 5, "e", 5, 0)]


def test_scalars(spark):
    row = spark.range(1).select(
        scalars.strip_fence(F.lit("say ```json\n{}\n``` so")).alias("fence"), scalars.strip_fence(F.lit(" bare\n")).alias("bare"), scalars.jaccard(F.array().cast("array<string>"), F.array().cast("array<string>")).alias("empty"),
        scalars.last_number(F.lit("none")).alias("none"), scalars.marked_number(F.lit(0.1234), F.lit(0.01)).alias("mark"), scalars.distance(F.array(F.lit(0.0), F.lit(0.0)), F.array(F.lit(3.0), F.lit(4.0))).alias("far"),
        scalars.valid_rating(F.lit('{"rating": 3}')).alias("ok"), scalars.valid_rating(F.lit("{")).alias("bad"), scalars.strip_html(F.lit("<p>a &amp;<script>x</script> b</p>")).alias("html"),
    ).first()
    assert tuple(row) == ("{}", "bare", 1.0, None, "0.123*", 5.0, True, False, "a & b")


def test_files_round_trip(spark, tmp_path):
    (tmp_path / "talk_1.csv").write_text('idx,utterance_text\n0,"a ""b"", c"\n1,"two\nlines"\n')
    got = files.read_transcripts(spark, str(tmp_path / "*.csv"), "idx int, utterance_text string").orderBy("idx").collect()
    assert [tuple(r) for r in got] == [(0, 'a "b", c', "talk_1"), (1, "two\nlines", "talk_1")]
    with pytest.raises(ValueError):
        files.read_transcripts(spark, str(tmp_path), "idx int")
    (tmp_path / "d.json").write_text(json.dumps([{"id": 1, "claims": [{"t": "x", "embedding": [0.5]}]}]))
    docs = files.read_documents(spark, files.first_existing(spark, str(tmp_path / "no.json"), str(tmp_path / "d.json")), "id int, claims array<struct<t: string, embedding: array<double>>>")
    assert files.without_field(docs, "claims", "embedding").first().claims == [("x",)]
    files.write_records(spark.createDataFrame([(1, "b"), (1, "a"), (None, "c"), (None, "d")], "k int, v string"), str(tmp_path / "out"), ["k"], "v")
    assert sorted(r.v for r in spark.read.json(str(tmp_path / "out")).collect()) == ["a", "c"]
    with pytest.raises(FileNotFoundError):
        files.first_existing(spark, str(tmp_path / "no"))


def test_stream_matches_batch(spark, tmp_path):
    rows = [(1, 0, "a b b"), (2, 0, "z"), (1, 1, "b c"), (1, 2, None), (2, 1, "Z y")]
    source = tmp_path / "in"
    for at in (0, 1, 2):
        spark.createDataFrame([r for r in rows if r[1] == at], "conv_id long, idx long, text string").coalesce(1).write.mode("append").json(str(source))
        if at < 2:
            _drain(spark, source, tmp_path)
    _drain(spark, source, tmp_path)
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()))
    assert got == [(1, 0, 2, 2, 0), (1, 1, 2, 1, 2), (1, 2, 0, 0, 3), (2, 0, 1, 1, 0), (2, 1, 2, 1, 1)]


def _drain(spark, source, tmp_path):
    stream = spark.readStream.schema("conv_id long, idx long, text string").json(str(source))
    query = novelty_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(90)
    assert query.exception() is None and not query.isActive


def test_merged_segments_of_conversations_in_one_group(spark, monkeypatch):
    rows = [(c, s, 2 * s, 2 * s + 2, 30 + c, 2) for c in range(40) for s in range(5)]
    frame = spark.createDataFrame(rows, "conv_id long, segment long, start long, end long, words long, n_turns long").repartition(3)
    got = {}
    for size in (1, 1000):
        monkeypatch.setattr(features, "SEGMENTS", size)
        got[size] = sorted(map(tuple, features.merge_segments(frame, 60, 120, 6).collect()))
    assert got[1] == got[1000] and got[1][:3] == [(0, 0, 0, 4, 60, 4), (0, 1, 4, 8, 60, 4), (0, 2, 8, 10, 30, 2)]
