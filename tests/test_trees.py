"""Forests, boosting and permutation importance against plain loops over rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import numbering, trees
from parley.operators.metrics import t_probability


@pytest.fixture(scope="module")
def sample(spark):
    rng = np.random.default_rng(8)
    x = np.stack([rng.normal(size=400), rng.integers(0, 4, size=400), rng.random(400) * 9, rng.normal(size=400)], axis=1).round(2)
    y = 1 + (x[:, 0] > 0) + ((x[:, 1] > 1) & (x[:, 2] > 4))
    y = np.where(rng.random(400) < 0.1, rng.integers(1, 4, size=400), y)
    rows = [(i, i * 7 % 5, int(c), *map(float, v)) for i, (c, v) in enumerate(zip(y, x, strict=True))]
    rows += [(900, 1, None, 1.0, 1.0, 1.0, 1.0), (901, 2, 2, None, 1.0, 1.0, 1.0), (902, 2, 9, 1.0, 1.0, 1.0, 1.0)]
    return spark.createDataFrame(rows, "id long, fold int, y int, a double, b double, c double, d double").repartition(3)


def plain_tree(row, target, bins, features, tries, seed, depth, least=1.0):
    """A tree by recursion over rows: every cut of every allowed feature is tried."""
    w = trees.row_weights(row, seed)
    feature, cut, value = {}, {}, {}

    def split(node, here, level):
        total, s = w[here].sum(), (w[here, None] * target[here]).sum(axis=0)
        value[node] = s / total
        if level == depth:
            return
        best = None
        for f in trees.node_features(features, tries, seed, node):
            for b in sorted(set(bins[here, f].tolist())):
                left, right = here[bins[here, f] <= b], here[bins[here, f] > b]
                lw, rw = w[left].sum(), w[right].sum()
                if lw >= least and rw >= least:
                    ls = (w[left, None] * target[left]).sum(axis=0)
                    gain = round(float((ls**2).sum() / lw + ((s - ls) ** 2).sum() / rw - (s**2).sum() / total), 9)
                    if best is None or gain > best[0]:
                        best = (gain, f, b, left, right)
        if best and best[0] > 1e-9:
            feature[node], cut[node] = best[1:3]
            split(2 * node, best[3], level + 1)
            split(2 * node + 1, best[4], level + 1)

    split(1, np.flatnonzero(w > 0), 0)

    def predict(b):
        out = []
        for r in b:
            node = 1
            while node in feature:
                node = 2 * node + int(r[feature[node]] > cut[node])
            out.append(value[node])
        return np.array(out)

    return predict


def local(data, classes):
    rows = data.rows.orderBy("row").collect()
    y = np.array([r.y for r in rows])
    target = np.eye(len(classes))[y.astype(int)] if classes else y[:, None]
    return np.array([r.row for r in rows]), np.array([r.fold for r in rows]), target, np.array([[r[f"b{i}"] for i in range(len(data.features))] for r in rows])


def test_bins_are_quantiles(sample):
    data = trees.Binned(sample, "y", ["a", "b", "c", "d"], "fold", ["id"], [1, 2, 3])
    row, _, _, bins = local(data, [1, 2, 3])
    clean = {r.h: r for r in sample.na.drop().select("*", F.xxhash64("id").alias("h")).collect()}
    assert len(row) == 401 - 1 and data.edges[1] == [0.0, 1.0, 2.0, 3.0]
    for h, b in zip(row.tolist(), bins.tolist(), strict=True):
        assert b == [sum(clean[h][c] > e for e in edges) for c, edges in zip("abcd", data.edges, strict=True)]
    data.close()


def test_forest_report_is_that_of_plain_trees(sample):
    got = {r.model: r for r in trees.forest_report(sample, "y", ["a"], ["b", "c"], "fold", ["id"], [1, 2, 3], trees=4, depth=3).collect()}
    data = trees.Binned(sample, "y", ["a", "b", "c"], "fold", ["id"], [1, 2, 3])
    row, fold, target, bins = local(data, [1, 2, 3])
    data.close()
    sets = {"base": (0,), "base+b": (0, 1), "base+c": (0, 2), "full": (0, 1, 2)}
    accuracy = {}
    for name, features in sets.items():
        each = []
        for f in range(5):
            train, test = fold != f, fold == f
            grown = [plain_tree(row[train], target[train], bins[train], features, max(1, math.isqrt(len(features))), k, 3) for k in range(4)]
            each.append((sum(p(bins[test]) for p in grown).argmax(axis=1) == target[test].argmax(axis=1)).mean())
        accuracy[name] = np.array(each)
    assert set(got) == set(sets)
    for name, a in accuracy.items():
        d = a - accuracy["base"]
        t = d.mean() / (d.std(ddof=1) / math.sqrt(5)) if d.std() > 0 else None
        assert (got[name].accuracy_mean, got[name].accuracy_sd, got[name].gain) == (pytest.approx(a.mean()), pytest.approx(a.std()), pytest.approx(d.mean()))
        assert got[name].t == (t if t is None else pytest.approx(t)) and got[name].p == (None if t is None else pytest.approx(t_probability(t, 4)))
    assert got["full"].accuracy_mean > got["base"].accuracy_mean


def test_importance_is_accuracy_lost_by_shuffling(sample):
    got = {r.feature: r for r in trees.permutation_importance(sample, "y", ["a", "b", "c", "d"], "fold", ["id"], [1, 2, 3], trees=4, depth=3, repeats=3).collect()}
    data = trees.Binned(sample, "y", ["a", "b", "c", "d"], "fold", ["id"], [1, 2, 3])
    row, _, target, bins = local(data, [1, 2, 3])
    order = {r: [x.row for x in data.rows.orderBy(F.xxhash64("row", F.lit(r))).collect()] for r in range(3)}
    data.close()
    grown = [plain_tree(row, target, bins, (0, 1, 2, 3), 2, k, 3) for k in range(4)]
    hits = lambda b: (sum(p(b) for p in grown).argmax(axis=1) == target.argmax(axis=1)).mean()
    at = {h: i for i, h in enumerate(row.tolist())}
    for f, name in enumerate("abcd"):
        lost = []
        for r in range(3):
            moved = bins.copy()
            moved[:, f] = bins[[at[h] for h in order[r]], f]
            lost.append(hits(bins) - hits(moved))
        assert (got[name].importance_mean, got[name].importance_sd) == (pytest.approx(np.mean(lost)), pytest.approx(np.std(lost)))
    assert got["a"].importance_mean > 0.1 > abs(got["d"].importance_mean)


def test_forest_and_boosting_errors(sample):
    got = {(r.model, r.fold): r for r in trees.tree_errors(sample, "y", ["a", "b", "c"], "fold", ["id"], trees=3, rounds=4, depth=2, rate=0.3).collect()}
    data = trees.Binned(sample, "y", ["a", "b", "c"], "fold", ["id"])
    row, fold, target, bins = local(data, None)
    data.close()
    assert len(got) == 10
    for f in range(5):
        train, test = fold != f, fold == f
        grown = [plain_tree(row[train], target[train], bins[train], (0, 1, 2), 1, k, 2) for k in range(3)]
        guess = {"forest": sum(p(bins[test]) for p in grown) / 3}
        left, total = target[train] - target[train].mean(), np.full((test.sum(), 1), target[train].mean())
        for _ in range(4):
            tree = plain_tree(row[train], left, bins[train], (0, 1, 2), 3, -1, 2)
            left, total = left - 0.3 * tree(bins[train]), total + 0.3 * tree(bins[test])
        guess["boosting"] = total
        for name, g in guess.items():
            e, y = (g - target[test])[:, 0], target[test][:, 0]
            r = got[name, f]
            assert (r.rmse, r.mae, r.n) == (pytest.approx(np.sqrt((e**2).mean())), pytest.approx(np.abs(e).mean()), len(e))
            assert r.r2 == pytest.approx(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())


def test_no_rows(sample):
    none = sample.limit(0)
    assert trees.forest_report(none, "y", ["a"], ["b"], "fold", ["id"], [1, 2], trees=2, depth=2).where("accuracy_mean is not null").count() == 0
    assert trees.tree_errors(none, "y", ["a"], "fold", ["id"], trees=2, rounds=1, depth=1).count() == 0
    assert [r.importance_mean for r in trees.permutation_importance(none, "y", ["a"], "fold", ["id"], [1, 2], trees=1, depth=1, repeats=1).collect()] == [0.0]


def test_numbers_follow_the_order(spark):
    rows = spark.range(1000).selectExpr("id", "xxhash64(id) as h").repartition(7)
    got = numbering.numbered(rows, "h", "n").orderBy("h").collect()
    assert [r.n for r in got] == list(range(1000))
    assert sorted(r.n for r in numbering.numbered(spark.range(50).selectExpr("1L as h"), "h", "n").collect()) == list(range(50))
    assert numbering.numbered(rows.limit(0), "h", "n").count() == 0
    named = spark.range(400).selectExpr("md5(string(id % 370)) as h").unionByName(spark.createDataFrame([(None,), (None,)], "h string"))
    got = numbering.numbered(named, "h", "n").orderBy("n").collect()
    assert [r.n for r in got] == list(range(402)) and [r.h for r in got] == sorted((r.h for r in got), key=lambda h: h or "")


def test_medians_are_exact(spark):
    rng = np.random.default_rng(5)
    for values in ([3.0], [1.0, 2.0], [5.0, 1.0, 1.0, 1.0], rng.normal(size=501).tolist(), rng.integers(0, 4, size=400).astype(float).tolist()):
        rows = spark.createDataFrame([(v,) for v in [*values, None]], "v double").repartition(3)
        assert numbering.median(rows, "v") == np.median(values)
    assert numbering.median(spark.createDataFrame([(None,)], "v double"), "v") is None
