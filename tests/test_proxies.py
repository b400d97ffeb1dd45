"""Dialogue inputs, proxies and evaluation by groups against loops and numpy."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import dialogues, proxies

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def slow_window(lines, at, quota, context):
    """Whole context if it fits, else one line less at a time."""
    begin = 0 if context is None else max(0, at - context)
    if quota <= 0:
        return at
    if sum(lines[begin:at]) <= quota:
        return begin
    while begin < at and sum(lines[begin:at]) >= quota:
        begin += 1
    return begin


@pytest.mark.parametrize("context", [None, 0, 1, 4])
def test_windows(spark, context):
    rng = random.Random(context)
    rows = [(c, 3 * i + c, rng.choice([0, 0, 1, 5, 9, 30]), rng.randrange(1, 60), rng.randrange(0, 5)) for c in range(12) for i in range(rng.randrange(1, 25))]
    frame = spark.createDataFrame(rows, "conv_id long, idx long, n_line int, n_target int, n_text int").repartition(3)
    got = {(r.conv_id, r.idx): r for r in dialogues.windows(frame, 70, context, n_meta=4).collect()}
    assert len(got) == len(rows)
    for c in range(12):
        own = [r for r in rows if r[0] == c]
        lines = [r[2] for r in own]
        for at, (_, idx, _, n_target, n_text) in enumerate(own):
            begin = slow_window(lines, at, 70 - 4 - 2 - n_target, context)
            r, size = got[c, idx], sum(lines[begin:at])
            assert (r.first_idx, r.n_context, r.context_ids) == (own[begin][1] if begin < at else None, at - begin, size)
            assert (r.n_ids, r.start) == (1 + 4 + size + n_target, 1 + 4 + size + n_target - n_text)
    assert dialogues.windows(frame.limit(0), 70, context).count() == 0


def test_inputs_of_real_ids(spark):
    from tokenizers import Tokenizer

    rng = random.Random(2)
    rows = [(c, i, f"s{i % 3}", "for", " ".join(rng.choice(["tax", "reform", "déjà", "vu", "the"]) for _ in range(rng.randrange(0, 30)))) for c in range(4) for i in range(12)]
    frame = spark.createDataFrame(rows, "conv_id long, idx long, speaker string, role string, text string")
    got = {(r.conv_id, r.idx): r for r in dialogues.encoded(frame, TOKENIZER, 80, 7, 8, context=5).collect()}
    ids = lambda t: Tokenizer.from_file(TOKENIZER).encode(t, add_special_tokens=False).ids
    for c in range(4):
        own = [r for r in rows if r[0] == c]
        lines = [ids(f"{r[2]} ({r[3]}): {r[4]} \n") for r in own]
        for at, r in enumerate(own):
            target = [*ids(f"{r[2]} ({r[3]}): {r[4]}"), 8]
            begin = slow_window([len(x) for x in lines], at, 80 - 2 - len(target), 5)
            want = [7, *(x for line in lines[begin:at] for x in line), *target]
            assert got[c, at].input_ids == want and got[c, at].start == len(want) - len(ids(r[4]))
            assert len(want) <= 80 or begin == at
    shown = frame.select("conv_id", "idx", F.lit(2).alias("n_context")).where("idx >= 2")
    texts = {(r.conv_id, r.idx): r.context for r in dialogues.context_texts(frame, shown).collect()}
    assert texts[1, 5] == "".join(f"{r[2]} ({r[3]}): {r[4]} \n" for r in rows[12 + 3 : 12 + 5]) and texts[1, 0] == ""


def ranks(v):
    order = np.argsort(v, kind="stable")
    out = np.empty(len(v))
    out[order] = np.arange(len(v))
    return np.array([out[v == x].mean() for x in v])


def spearman(a, b):
    return np.corrcoef(ranks(np.asarray(a, float)), ranks(np.asarray(b, float)))[0, 1]


def test_feature_maps_and_labels(spark):
    a = spark.createDataFrame([("insq_12", 5, 0), ("insq_12", 5, 0), ("x", 6, 1)], "conversation_id string, utterance_id long, utterance_index long")
    b = spark.createDataFrame([("12", "5", 0, 1.0), (None, "7", None, 2.0)], "conversation_id string, utterance_id string, utterance_index int, other double")
    found = proxies.feature_map(a, b)
    assert {tuple(r) for r in found.collect()} == {("12", "5", "0"), ("x", "6", "1"), (None, "7", None)}
    labels = spark.createDataFrame([("id-12", 5, 3.0), ("id-13", 5, 1.0)], "conv_id string, utterance_id long, y_cont double")
    assert [(r.conversation_id, r.utterance_index, r.y_cont) for r in proxies.mapped_labels(labels, found).collect()] == [("12", "0", 3.0)]


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(12)
    group = rng.integers(0, 23, size=300) ** 2 % 19
    x = np.stack([rng.normal(size=300).round(1), rng.integers(0, 4, size=300), rng.random(300) * 50], axis=1)
    y = np.clip(np.round(2 + 0.7 * x[:, 0] + 0.3 * x[:, 1] + rng.normal(size=300) * 0.5), 1, 4)
    rows = [(i, f"g{g}", float(t), *map(float, v), "text") for i, (g, t, v) in enumerate(zip(group, y, x, strict=True))]
    frame = spark.createDataFrame(rows, "id long, g string, y double, a double, b double, c double, name string")
    return group, y, x, frame


def test_proxies_follow_the_target(spark, sample):
    _, y, x, frame = sample
    features, targets = frame.drop("y").withColumn("few", F.when(F.col("id") < 5, 1.0)).withColumn("same", F.lit(1)), frame.select("id", "y")
    only = spark.range(0, 200)
    got = {r.proxy: r for r in proxies.proxies(features, targets, ["id"], "y", ["c"], only).collect()}
    assert set(got) == {"a", "b", "same"} and got["same"].spearman is None and got["same"].rank == 3
    for i, c in enumerate("ab"):
        assert got[c].spearman == pytest.approx(spearman(y[:200], x[:200, i]), abs=2e-6)
        assert got[c].pearson == pytest.approx(np.corrcoef(y[:200], x[:200, i])[0, 1], abs=2e-6) and got[c].n == 200
    assert proxies.numeric_columns(frame, ["y"]) == ["id", "a", "b", "c"]
    pairs = {(r.a, r.b): r for r in proxies.matrix(frame, ["id"], ["y", "a", "b"]).collect()}
    assert pairs["y", "b"].spearman == pytest.approx(spearman(y, x[:, 1]), abs=2e-6) and pairs["a", "b"].n == 300


def test_groups_stay_in_one_fold(spark, sample):
    group, _, _, frame = sample
    got = proxies.balanced_folds(frame, "g", 5).collect()
    assert len(got) == len({r.g for r in got}) == len(set(group)) and {r.fold for r in got} == set(range(5))
    size = {r.g: (group == int(r.g[1:])).sum() for r in got}
    by_fold = [sum(size[r.g] for r in got if r.fold == k) for k in range(5)]
    assert max(by_fold) - min(by_fold) <= max(size.values())


def folds_of(frame, group):
    fold = {r.g: r.fold for r in proxies.balanced_folds(frame, "g", 5).collect()}
    return np.array([fold[f"g{g}"] for g in group])


def test_evaluation_against_numpy(sample):
    group, y, x, frame = sample
    fold = folds_of(frame, group)
    got = {r.proxy: r for r in proxies.evaluate_proxies(frame.withColumn("none", F.lit(None).cast("double")), "y", ["a", "b", "none"], "g", "c").collect()}
    assert set(got) == {"a", "b"}
    line = np.polyfit(x[:, 2], y, 1)
    left = (y - np.polyval(line, x[:, 2])).round(12)
    for i, c in enumerate("ab"):
        v, r = x[:, i], got[c]
        error = np.abs(y - v)
        assert (r.n, r.mae, r.rmse) == (300, pytest.approx(error.mean(), abs=2e-6), pytest.approx(math.sqrt((error**2).mean()), abs=2e-6))
        assert r.nmae == pytest.approx(error.mean() / 3, abs=2e-6) and r.spearman == pytest.approx(spearman(left, v), abs=1e-4)
        assert r.spearman_folds == pytest.approx(np.mean([spearman(left[fold == k], v[fold == k]) for k in range(5)]), abs=1e-3)
        assert r.mae_folds == pytest.approx(np.mean([error[fold == k].mean() for k in range(5)]), abs=2e-6)


def test_comparison_of_features_against_numpy(spark, sample):
    group, y, x, frame = sample
    holed = frame.withColumn("b", F.when(F.col("id") % 9 > 0, F.col("b")))
    got = {r.feature: r for r in proxies.compare_features(holed, ["id"], "y", ["a", "b", "c"], "g", seed=3).collect()}
    hole = np.arange(300) % 9 == 0
    filled = x.copy()
    filled[hole, 1] = np.percentile(x[~hole, 1], 50, method="inverted_cdf")
    z = (filled - filled.mean(axis=0)) / filled.std(axis=0)
    t = (y - y.mean()) / y.std()
    slope = np.linalg.lstsq(z, t, rcond=None)[0]
    fold = folds_of(frame, group)
    hashes = {r.id: (r.a, r.b) for r in frame.select("id", F.pmod(F.xxhash64(F.xxhash64("id")), F.lit(1 << 40)).alias("a"), F.pmod(F.xxhash64(F.xxhash64("id"), F.lit(4)), F.lit(1 << 40)).alias("b")).collect()}
    lost = {c: ([], []) for c in "abc"}
    for k in range(5):
        train, test = fold != k, np.flatnonzero(fold == k)
        mean, sd = filled[train].mean(axis=0), filled[train].std(axis=0)
        zt = (filled[train] - mean) / sd
        w = np.linalg.solve(zt.T @ zt + np.eye(3), zt.T @ (y[train] - y[train].mean()))
        first = sorted(test, key=lambda i: hashes[i][0])
        second = sorted(test, key=lambda i: hashes[i][1])
        guess = lambda v, w=w, mean=mean, sd=sd, train=train: y[train].mean() + ((v - mean) / sd) @ w
        base = guess(filled[first])
        for i, c in enumerate("abc"):
            moved = filled[first].copy()
            moved[:, i] = filled[second, i]
            lost[c][0].append(spearman(y[first], base.round(9)) - spearman(y[first], guess(moved).round(9)))
            lost[c][1].append(np.abs(y[first] - guess(moved)).mean() - np.abs(y[first] - base).mean())
    for i, c in enumerate("abc"):
        r, others = got[c], [j for j in range(3) if j != i]
        keep = ~hole if c == "b" else slice(None)
        assert r.spearman == pytest.approx(spearman(y[keep], x[keep, i]), abs=2e-6) and r.mae == pytest.approx(np.abs(y[keep] - x[keep, i]).mean(), abs=2e-6)
        assert r.standard_slope == pytest.approx(slope[i], abs=2e-6)
        left = lambda v, others=others: v - z[:, others] @ np.linalg.lstsq(z[:, others], v, rcond=None)[0]
        assert r.partial_spearman == pytest.approx(spearman(left(t).round(9), left(z[:, i]).round(9)), abs=1e-3)
        assert (r.drop_spearman, r.rise_mae) == (pytest.approx(np.mean(lost[c][0]), abs=1e-3), pytest.approx(np.mean(lost[c][1]), abs=2e-6))
    total = 1 - ((t - z @ slope) ** 2).sum() / (t**2).sum()
    assert sum(r.shapley_r2 for r in got.values()) == pytest.approx(total, abs=5e-6)


def test_matrix_of_a_constant_column(spark):
    rows = spark.createDataFrame([(i, float(i), 2.0 * i, 4.0) for i in range(5)], "k int, x double, y double, flat double")
    got = {(r.a, r.b): (r.pearson, r.spearman, r.n) for r in proxies.matrix(rows, ["k"], ["x", "y", "flat"]).collect()}
    assert got["x", "y"] == (1.0, 1.0, 5)
    assert all(math.isnan(v) for b in ("x", "y") for v in got[b, "flat"][:2])
    assert [r.pearson for r in proxies.matrix(rows.limit(0), ["k"], ["x", "y"]).collect()] == [None]
