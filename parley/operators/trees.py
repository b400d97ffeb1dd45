"""Random forests and boosted trees from histograms of binned features.

Features are cut into at most `BINS` bins at quantiles. All trees of all fits (folds and sets of features) grow side by
side, a level at a time: one pass over the rows sums weights and targets by tree, node, feature and bin, and the best cut of
each node is picked from these sums, so that only a row a node reaches the driver. Classes are one-hot targets, for which the
gain in squared sums is that of Gini's impurity; a number is a target of its own. Rows with a null are left out.

Nothing is drawn at random: a row's weight in a tree (Poisson of mean one, as in a bootstrap) and the features that a node
may use come from hashes of its keys, the tree and the node, so that lost tasks come back with the same rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.metrics import t_probability
from parley.operators.numbering import numbered

BINS = 32
#: Shares of rows at which Poisson weights of mean one go up: P(0), P(0) + P(1), ...
_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(9)])


def mixed(x: np.ndarray | int, seed: int) -> np.ndarray:
    """Well-spread 64-bit numbers from numbers and a seed."""
    with np.errstate(over="ignore"):
        z = np.asarray(x).astype(np.int64).view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
        z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return z ^ (z >> np.uint64(31))


def row_weights(rows: np.ndarray, seed: int) -> np.ndarray:
    """How often each row is in a tree's bootstrap; a negative seed takes every row once."""
    if seed < 0:
        return np.ones(len(rows))
    return np.searchsorted(_POISSON, (mixed(rows, seed + 1) >> np.uint64(11)).astype(np.float64) / 2.0**53, side="right").astype(np.float64)


def node_features(features: tuple[int, ...], count: int, seed: int, node: int) -> list[int]:
    """The features that a node may be cut by: all, or `count` of them by hash."""
    if count >= len(features):
        return list(features)
    order = np.argsort(mixed(np.array(features), 1_000_003 * (seed + 2) + node), kind="stable")
    return sorted(int(features[i]) for i in order[:count])


@dataclass
class Tree:
    """Nodes as in a heap, the root at 1: the feature that cuts a node (-1: a leaf), the last bin on its left, and its value."""

    fit: int
    skip: int  # the fold that is left out, -1: none
    features: tuple[int, ...]
    seed: int
    depth: int
    outputs: int
    feature: np.ndarray = field(init=False)
    cut: np.ndarray = field(init=False)
    value: np.ndarray = field(init=False)

    def __post_init__(self):
        size = 2 ** (self.depth + 1)
        self.feature, self.cut, self.value = np.full(size, -1), np.zeros(size, dtype=np.int64), np.zeros((size, self.outputs))

    def nodes(self, bins: np.ndarray) -> np.ndarray:
        at = np.ones(len(bins), dtype=np.int64)
        for _ in range(self.depth):
            by = self.feature[at]
            right = bins[np.arange(len(bins)), np.maximum(by, 0)] > self.cut[at]
            at = np.where(by < 0, at, 2 * at + right)
        return at

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.nodes(bins)]


class Binned:
    """Rows cut into bins: (row, fold, y, b0, b1, ...), kept for the passes over them; `close` lets them go."""

    def __init__(self, rows: DataFrame, target: str, features: list[str], fold: str, keys: list[str], classes: list | None = None):
        self.features, self.classes = list(features), classes
        names = [f"v{i}" for i in range(len(features))]
        # Each class by its place; a number as it is.
        y = F.col(target).cast("double") if classes is None else (F.array_position(F.array(*(F.lit(c) for c in classes)), F.col(target)) - 1).cast("double")
        clean = rows.select(F.xxhash64(*keys).alias("row"), F.col(fold).cast("int").alias("fold"), y.alias("y"), *(F.col(c).cast("double").alias(n) for c, n in zip(features, names, strict=True))).na.drop()
        clean = clean.where("y >= 0") if classes else clean
        at = [(k + 1) / BINS for k in range(BINS - 1)]
        found = clean.agg(*(F.percentile_approx(n, at, 10_000) for n in names)).first()
        self.edges = [sorted(set(e or [])) for e in found]
        bins = [sum(((F.col(n) > float(e)).cast("int") for e in edges), F.lit(0)) for n, edges in zip(names, self.edges, strict=True)]
        self.rows = clean.select("row", "fold", "y", *(b.cast("int").alias(f"b{i}") for i, b in enumerate(bins))).persist()

    @property
    def outputs(self) -> int:
        return len(self.classes) if self.classes else 1

    def close(self) -> None:
        self.rows.unpersist()


def _arrays(rows: pa.RecordBatch, outputs: int) -> tuple[np.ndarray, ...]:
    names = [n for n in rows.schema.names if n.startswith("b")]
    bins = np.stack([rows.column(n).to_numpy() for n in sorted(names, key=lambda n: int(n[1:]))], axis=1)
    y = rows.column("y").to_numpy()
    target = np.eye(outputs)[y.astype(int)] if outputs > 1 else y[:, None]
    return rows.column("row").to_numpy(), rows.column("fold").to_numpy(), target, bins


def grow(data: Binned, trees: list[Tree], tries: int, least: float = 1.0, before: list[list[Tree]] | None = None, rate: float = 0.0) -> None:
    """Grow trees to their depth, a pass over the rows a level.

    tries: features that a node may use; least: weight of a leaf. before: by fit, the trees whose predictions times `rate`
    are taken from the target first, as in boosting.
    """
    outputs, spark = data.outputs, data.rows.sparkSession
    names = ["w", *(f"s{k}" for k in range(outputs))]
    if not trees:
        return
    for level in range(max(t.depth for t in trees)):
        open_nodes = {i: ([1] if level == 0 else [n for n in range(2**level, 2 ** (level + 1)) if t.feature[n // 2] >= 0]) for i, t in enumerate(trees) if level < t.depth}
        if not any(open_nodes.values()):
            break
        shared = spark.sparkContext.broadcast((trees, before))

        def sums(batches: Iterator[pa.RecordBatch], shared=shared, open_nodes=open_nodes) -> Iterator[pa.RecordBatch]:
            trees, before = shared.value
            for rows in batches:
                if not rows.num_rows:
                    continue
                row, fold, target, bins = _arrays(rows, outputs)
                left = {}
                for fit, earlier in enumerate(before or []):
                    left[fit] = target - rate * sum((t.predict(bins) for t in earlier), np.zeros_like(target))
                out = [[] for _ in range(4 + len(names))]
                for i, nodes in open_nodes.items():
                    tree = trees[i]
                    w = row_weights(row, tree.seed) * (fold != tree.skip)
                    y, at = left.get(tree.fit, target), tree.nodes(bins)
                    for node in nodes:
                        here = np.flatnonzero((at == node) & (w > 0))
                        for f in node_features(tree.features, tries, tree.seed, node) if len(here) else []:
                            b = bins[here, f]
                            weight = np.bincount(b, weights=w[here])
                            found = np.flatnonzero(weight)
                            columns = [np.full(len(found), i), np.full(len(found), node), np.full(len(found), f), found, weight[found]]
                            columns += [np.bincount(b, weights=w[here] * y[here, k])[found] for k in range(outputs)]
                            for kept, more in zip(out, columns, strict=True):
                                kept.append(more)
                if out[0]:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["tree", "node", "feature", "bin", *names])

        schema = "tree long, node long, feature long, bin long, " + ", ".join(f"{n} double" for n in names)
        cells = data.rows.mapInArrow(sums, schema).groupBy("tree", "node", "feature", "bin").agg(*(F.sum(n).alias(n) for n in names))
        for r in best_cuts(cells, outputs, least).collect():  # a row a node
            tree, node = trees[r.tree], r.node
            tree.value[node] = [r[f"s{k}"] / r.w for k in range(outputs)]
            if r.best is not None and r.best.gain > 1e-9:
                tree.feature[node], tree.cut[node] = -r.best.feature, -r.best.bin
                right = r.w - r.best.lw
                tree.value[2 * node] = [r.best[f"l{k}"] / r.best.lw for k in range(outputs)]
                tree.value[2 * node + 1] = [(r[f"s{k}"] - r.best[f"l{k}"]) / right for k in range(outputs)]


def best_cuts(cells: DataFrame, outputs: int, least: float) -> DataFrame:
    """(tree, node, w, s0, ..., best): totals of each node, and its cut of highest gain; ties go to the first feature and bin."""
    of = Window.partitionBy("tree", "node", "feature")
    so_far = of.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    s = [f"s{k}" for k in range(outputs)]
    run = cells.select("tree", "node", "feature", "bin", F.sum("w").over(so_far).alias("lw"), *(F.sum(c).over(so_far).alias(f"l{k}") for k, c in enumerate(s)), F.sum("w").over(of).alias("w"), *(F.sum(c).over(of).alias(c) for c in s))
    rest = F.col("w") - F.col("lw")
    square = lambda parts: sum((p * p for p in parts), F.lit(0.0))
    gain = square([F.col(f"l{k}") for k in range(outputs)]) / F.col("lw") + F.try_divide(square([F.col(c) - F.col(f"l{k}") for k, c in enumerate(s)]), rest) - square([F.col(c) for c in s]) / F.col("w")
    good = (F.col("lw") >= least) & (rest >= least)
    best = F.struct(F.round(gain, 9).alias("gain"), (-F.col("feature")).alias("feature"), (-F.col("bin")).alias("bin"), "lw", *(f"l{k}" for k in range(outputs)))
    return run.groupBy("tree", "node").agg(F.max("w").alias("w"), *(F.max(c).alias(c) for c in s), F.max(F.when(good, best)).alias("best"))


def scores(data: Binned, forests: dict[int, list[Tree]], rate: float | None = None) -> dict[tuple[int, int], np.ndarray]:
    """By fit and fold: rows, hits or absolute errors, squared errors, sum and squared sum of the target.

    A fit is scored on the fold that its trees leave out, or on all rows (fold -1). Forests take the mean of their trees, boosted ones `rate` times the sum.
    """
    outputs = data.outputs
    shared = data.rows.sparkSession.sparkContext.broadcast(forests)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            _, fold, target, bins = _arrays(rows, outputs)
            out = []
            for fit, trees in shared.value.items():
                skip = trees[0].skip
                at = np.flatnonzero(fold == skip) if skip >= 0 else np.arange(len(fold))
                if len(at):
                    guess = sum(t.predict(bins[at]) for t in trees) * (1 / len(trees) if rate is None else rate)
                    out.append((fit, skip, *scored(guess, target[at])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in zip(*out, strict=True)], ["fit", "fold", *_SCORES])

    got = data.rows.mapInArrow(run, "fit double, fold double, " + ", ".join(f"{c} double" for c in _SCORES)).groupBy("fit", "fold").agg(*(F.sum(c) for c in _SCORES))
    return {(int(r[0]), int(r[1])): np.array(r[2:]) for r in got.collect()}  # a row a fit


_SCORES = ("n", "first", "squared", "y", "yy")


def scored(guess: np.ndarray, target: np.ndarray) -> tuple[float, ...]:
    if target.shape[1] > 1:
        return len(target), float((guess.argmax(axis=1) == target.argmax(axis=1)).sum()), 0.0, 0.0, 0.0
    e, y = (guess - target)[:, 0], target[:, 0]
    return len(y), float(np.abs(e).sum()), float((e**2).sum()), float(y.sum()), float((y**2).sum())


def forest(data: Binned, fits: list[tuple[int, tuple[int, ...]]], trees: int, depth: int, least: float = 1.0) -> dict[int, list[Tree]]:
    """A forest for each fit (the fold to leave out, features); a node may use the root of their number."""
    out = {i: [Tree(i, skip, features, k, depth, data.outputs) for k in range(trees)] for i, (skip, features) in enumerate(fits)}
    for count in {len(f) for _, f in fits}:  # as many features, as many tries
        own = [t for ts in out.values() for t in ts if len(t.features) == count]
        grow(data, own, max(1, math.isqrt(count)), least)
    return out


def boosted(data: Binned, fits: list[tuple[int, tuple[int, ...]]], rounds: int, depth: int, rate: float, least: float = 1.0) -> dict[int, list[Tree]]:
    """Trees that each fit what those before leave of the target, all features and rows each; the first is the mean."""
    out: dict[int, list[Tree]] = {i: [] for i in range(len(fits))}
    for round_ in range(rounds + 1) if fits else ():
        new = [Tree(i, skip, features, -1, depth if round_ else 1, 1) for i, (skip, features) in enumerate(fits)]
        grow(data, new, max(len(f) for _, f in fits), least if round_ else math.inf, [out[i] for i in range(len(fits))], rate)
        for tree in new:
            if not round_:  # counts in full
                tree.value /= rate
            out[tree.fit].append(tree)
    return out


def forest_report(rows: DataFrame, target: str, base: list[str], added: list[str], fold: str, keys: list[str], classes: list, trees: int = 50, depth: int = 5) -> DataFrame:
    """(model, accuracy_mean, accuracy_sd, gain, t, p): mean and deviation over folds of a forest's accuracy.

    Models are the base features, the base with each added one, and all; gain, Student's t and its probability are those of the
    paired differences to the base by fold. All models see the same rows. The folds are those of the data; they are few.
    """
    data = Binned(rows, target, [*base, *added], fold, keys, classes)
    first = tuple(range(len(base)))
    sets = {"base": first} | {f"base+{a}": (*first, len(base) + i) for i, a in enumerate(added)} | {"full": tuple(range(len(base) + len(added)))}
    folds = sorted(r[0] for r in data.rows.select("fold").distinct().collect())
    fits = [(f, s) for s in sets.values() for f in folds]
    got = scores(data, forest(data, fits, trees, depth))
    accuracy = {name: np.array([got[j * len(folds) + i, f][1] / got[j * len(folds) + i, f][0] for i, f in enumerate(folds)]) for j, name in enumerate(sets)}
    out = []
    for name, a in accuracy.items():
        more = a - accuracy["base"]
        sd = more.std(ddof=1) if len(more) > 1 else 0.0
        t = float(more.mean() / (sd / math.sqrt(len(more)))) if sd > 0 else None
        out.append((name, float(a.mean()), float(a.std()), float(more.mean()), t, t_probability(t, len(more) - 1)) if len(a) else (name, None, None, None, None, None))
    data.close()
    return rows.sparkSession.createDataFrame(out, "model string, accuracy_mean double, accuracy_sd double, gain double, t double, p double")


def permutation_importance(rows: DataFrame, target: str, features: list[str], fold: str, keys: list[str], classes: list, trees: int = 50, depth: int = 5, repeats: int = 10) -> DataFrame:
    """(feature, importance_mean, importance_sd): how much accuracy a forest loses on its own rows when one feature is shuffled.

    A shuffle is a join: rows are numbered in the order of a hash, and in that of another; rows of equal number swap values.
    """
    data = Binned(rows, target, features, fold, keys, classes)
    own = forest(data, [(-1, tuple(range(len(features))))], trees, depth)[0]
    shared, outputs = rows.sparkSession.sparkContext.broadcast(own), data.outputs
    size = len(features)
    plain = numbered(data.rows, "row", "number")
    hits = []
    for r in range(repeats):
        other = numbered(data.rows.select(F.xxhash64("row", F.lit(r)).alias("h"), "row", *(F.col(f"b{i}").alias(f"o{i}") for i in range(size))), "h", "number").drop("h", "row")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part in batches:
                if part.num_rows:
                    _, _, target, bins = _arrays(part, outputs)
                    found = []
                    for f in [None, *range(size)]:
                        moved = bins.copy()
                        if f is not None:
                            moved[:, f] = part.column(f"o{f}").to_numpy()
                        found.append(scored(sum(t.predict(moved) for t in shared.value), target)[1])
                    yield pa.RecordBatch.from_arrays([pa.array(range(size + 1)), pa.array(found)], ["at", "hits"])

        joined = plain.join(other, "number")
        hits.append(dict(joined.mapInArrow(run, "at long, hits double").groupBy("at").agg(F.sum("hits")).collect()))
    n = data.rows.count()
    data.close()
    lost = np.array([[(h[0] - h[f + 1]) / n for h in hits] for f in range(size)]) if n else np.zeros((size, 1))
    return rows.sparkSession.createDataFrame([(f, float(lost[i].mean()), float(lost[i].std())) for i, f in enumerate(features)], "feature string, importance_mean double, importance_sd double")


def tree_errors(rows: DataFrame, target: str, features: list[str], fold: str, keys: list[str], trees: int = 50, rounds: int = 50, depth: int = 3, rate: float = 0.1) -> DataFrame:
    """(model, fold, rmse, mae, r2, n): errors on each fold of a forest and of boosted trees fitted to all other folds."""
    data = Binned(rows, target, features, fold, keys)
    folds = sorted(r[0] for r in data.rows.select("fold").distinct().collect())
    fits = [(f, tuple(range(len(features)))) for f in folds] if len(folds) > 1 else []
    models = {"forest": (forest(data, fits, trees, depth), None), "boosting": (boosted(data, fits, rounds, depth, rate), rate)}
    out = []
    for name, (grown, rate_) in models.items():
        for (_, f), (n, absolute, squared, y, yy) in sorted(scores(data, grown, rate_).items()) if fits else []:
            spread = yy - y * y / n
            out.append((name, f, math.sqrt(squared / n), float(absolute / n), float(1 - squared / spread) if spread > 1e-12 else None, int(n)))
    data.close()
    return rows.sparkSession.createDataFrame(out, "model string, fold int, rmse double, mae double, r2 double, n long")
