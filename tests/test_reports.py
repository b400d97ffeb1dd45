"""Correlations, tests, pruning, regressions, claims and allocation against plain calculations, and their odd cases."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from parley.operators import allocation, claims, metrics, ranks, regression


def test_chi_square_matches_tables():
    for x, freedom in ((3.841459, 1), (5.991465, 2), (18.307038, 10), (124.342113, 100)):
        assert ranks.chi_square_probability(x, freedom) == pytest.approx(0.05, abs=1e-6)
    assert ranks.chi_square_probability(0.0, 3) == 1.0 and ranks.chi_square_probability(None, 3) is None
    assert ranks.likelihood_ratio(-10.0, -10.0 + 3.841459 / 2, 1)[1] == pytest.approx(0.05, abs=1e-6)


@pytest.mark.parametrize("parts", [2, 256])
def test_average_ranks_match_pandas(spark, parts):
    rng = random.Random(5)
    rows = [(g, float(rng.choice([7, rng.randrange(100)]))) for g in "ab" for _ in range(400)]
    want = pd.DataFrame(rows, columns=["g", "x"])
    want["rank"] = want.groupby("g")["x"].rank()
    cells = spark.createDataFrame(rows, "g string, x double").groupBy("g", "x").agg(F.count("*").alias("n"))
    got = {(r.g, r.x): r.x_rank for r in ranks.average_ranks(cells, "x", "g", parts=parts).collect()}
    assert got == {(r.g, r.x): r.rank for r in want.itertuples()}


def test_correlations_of_odd_groups(spark):
    line = [("line", float(i), 2.0 * i) for i in range(12)]
    flat = [("flat", 1.0, float(i)) for i in range(12)]
    few = [("few", float(i), float(i)) for i in range(9)] + [("few", None, 1.0)]
    got = {r.g: r for r in ranks.correlations(spark.createDataFrame(line + flat + few, "g string, x double, y double"), "g").collect()}
    assert set(got) == {"line", "flat"}
    assert (got["line"].spearman, got["line"].pearson) == (1.0, 1.0) and got["line"].pearson_p < 1e-50
    assert got["flat"].pearson is None and got["flat"].spearman_p is None


def test_paired_t(spark):
    d = [1.0, 2.0, 3.0, 4.0]
    rows = [("a", x, 0.0) for x in d] + [("one", 1.0, 0.0), ("same", 2.0, 1.0), ("same", 3.0, 2.0), ("a", None, 1.0)]
    got = {r.g: r for r in ranks.paired_t(spark.createDataFrame(rows, "g string, x double, y double"), "g").collect()}
    assert got["a"].t == pytest.approx(2.5 / (math.sqrt(5 / 3) / 2), abs=1e-5) and got["a"].n == 4
    assert got["a"].p == pytest.approx(0.0304662, abs=1e-5)
    assert got["one"].t is None and got["same"].t is None


def _kappa(pairs):
    levels = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(levels)}
    seen = sum((at[a] - at[b]) ** 2 for a, b in pairs) * len(pairs)
    chance = sum((at[a] - at[b]) ** 2 for a, _ in pairs for _, b in pairs)
    return 1 - seen / chance if chance else None


def test_pruning_matches_a_plain_loop(spark):
    rng = random.Random(11)
    said = {r: {i: rng.randrange(1, 5) for i in range(30) if rng.random() < 0.6} for r in range(6)}
    said[9] = {99: 2}
    rows = [(1, i, "A", r, v) for r, items in said.items() for i, v in items.items()]
    left, want = set(said), {}
    while len(left) > 3:
        marks = []
        for a in left:
            s = n = 0
            for b in left - {a}:
                shared = [(said[min(a, b)][i], said[max(a, b)][i]) for i in said[a] if i in said[b]]
                k = _kappa(shared) if shared else None
                n += len(shared)
                s += k * len(shared) if k is not None else 0
            marks.append((round(s / n, 6) if n else -math.inf, n, a))
        worst = min(marks)[2]
        want[worst] = len(want) + 1
        left.remove(worst)
    got = metrics.prune(spark.createDataFrame(rows, "conv_id long, utterance_id long, aspect string, rater_id long, rating int"), 3).collect()
    assert {r.rater_id: r.removed_at for r in got if r.removed_at} == want
    assert {r.rater_id for r in got if r.removed_at is None} == left and want[9] == 1


def test_regression_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(200, 3))
    y = 4 + x @ [1.0, -2.0, 0.0] + rng.normal(size=200)
    rows = [(float(t), *map(float, r)) for t, r in zip(y, x, strict=True)] + [(1.0, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "y double, a double, b double, c double")
    m = regression.Moments(df, "y", ["a", "b", "c"])
    full = np.linalg.lstsq(np.c_[np.ones(200), x], y, rcond=None)
    start, slopes, left = m.fit(["a", "b", "c"])
    assert np.allclose([start, *slopes], full[0]) and left == pytest.approx(full[1][0])
    part = np.linalg.lstsq(np.c_[np.ones(200), x[:, :2]], y, rcond=None)[1][0]
    f, p = m.nested(["a", "b"], ["a", "b", "c"])
    assert f == pytest.approx((part - left) / (left / 196)) and p == pytest.approx(metrics.t_probability(math.sqrt(f), 196), abs=1e-8)
    assert sum(m.shapley().values()) == pytest.approx(m.r2(["a", "b", "c"]))
    by_order = [m.r2(list(o[: o.index("a") + 1])) - m.r2(list(o[: o.index("a")])) for o in itertools.permutations(["a", "b", "c"])]
    assert m.shapley()["a"] == pytest.approx(np.mean(by_order))
    empty = regression.report(df.where("false"), "y", ["a"]).collect()[0]
    assert (empty.slope, empty.f, empty.n) == (0.0, None, 0)


def test_claims_of_odd_rows(spark):
    said = spark.createDataFrame([(1, 1, "a b-c d'e"), (1, 2, None), (1, 3, "")], "conv_id long, utterance_id long, text string")
    rows = [(1, 1, 1, 4, None, 2, 1, "ADD", "neutral"), (1, 1, 2, 1, None, 2, 1, None, None)]
    of = spark.createDataFrame(rows, "conv_id long, utterance_id long, claim_id long, info int, novo int, relv int, imsc int, action string, relation string")
    got = {r.utterance_id: r for r in claims.claim_features(of, said).collect()}
    a, b = got[1], got[2]
    assert (a.n_tokens, a.n_claims, a.n_changes, a.mean_info, a.median_info, a.harmonic_info, a.top_quarter_info) == (3, 2, 2, 2.5, 2.5, 1.6, 4.0)
    assert (a.mean_novo, a.share_act_ADD, a.act_entropy) == (1.0, 0.5, 0.0)
    assert (b.n_claims, b.n_tokens, b.claim_density, b.max_info, b.rel_entropy) == (0, 0, 0.0, 1.0, 1.0)
    deltas = {r.utterance_id: r for r in claims.memory_deltas(of, said).collect()}
    assert (deltas[1].mem_delta, deltas[1].delta_info, deltas[1].delta_triad, deltas[1].used, deltas[3].used) == (2, 1, 0, True, False)
    lines = claims.memory_lines(spark.createDataFrame([(1, "10", "x", "c"), (1, "9", None, "d"), (1, "?", "y", None)], "conv_id long, turn_id string, speaker string, claim string"))
    assert lines.first().memories == '- (Turn #9) Unknown: "d"\n- (Turn #10) x: "c"\n- (Turn #?) y: ""\n'


def test_allocation_of_odd_rows(spark):
    users = spark.createDataFrame([(1,), (2,), (3,)], "user_id long")
    groups = spark.createDataFrame([(10, 2), (11, 2), (12, 0), (13, 3)], "group_id long, n_participants long")
    done = spark.createDataFrame([(1, 10), (1, 10), (2, 10), (2, 11), (2, 12)], "user_id long, group_id long")
    assert dict(map(tuple, allocation.next_group(users, groups, done).collect())) == {1: 11, 2: None, 3: 10}
    assert dict(map(tuple, allocation.next_group(users, groups.where("false"), done.where("false")).collect())) == {1: None, 2: None, 3: None}
    ids = spark.createDataFrame([(1, "t_10"), (1, "t_9"), (1, "t")], "conv_id long, task_id string")
    assert allocation.upload(ids).first().tasks == ["t", "t_9", "t_10"]


def test_correlations_of_a_constant_fraction(spark):
    # In some of these groups the sums of squares leave a spread above zero.
    rows = [(f"{side}{k}", *((k / 7, float(i % 17)) if side == "x" else (float(i % 17), k / 7))) for side in "xy" for k in range(8, 20) for i in range(1000)]
    got = ranks.correlations(spark.createDataFrame(rows, "g string, x double, y double"), "g").collect()
    assert len(got) == 24 and {(r.spearman, r.pearson, r.pearson_p) for r in got} == {(None, None, None)}
