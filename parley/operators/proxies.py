"""How well columns stand for a target: correlation drivers, partial and permuted effects, evaluation by groups."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from parley.functions.scalars import last_number
from parley.operators.metrics import kendall
from parley.operators.models import _slopes
from parley.operators.numbering import numbered
from parley.operators.ranks import average_ranks, correlations
from parley.operators.regression import Moments


def plain_id(column: str):
    """An id's last number, or the id as it is where it has none."""
    text = F.col(column).cast("string")
    return F.coalesce(last_number(text).cast("string"), text)


def feature_map(*features: DataFrame) -> DataFrame:
    """Distinct (conversation_id, utterance_id, utterance_index) of tables of features, ids as text."""
    rows = [f.select(plain_id("conversation_id").alias("conversation_id"), *(F.col(c).cast("string").alias(c) for c in ("utterance_id", "utterance_index"))) for f in features]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.distinct()


def mapped_labels(labels: DataFrame, features: DataFrame) -> DataFrame:
    """Labels (conv_id, utterance_id, ...) with the places of their utterances from a feature map; those that it lacks go."""
    keyed = labels.withColumn("conversation_id", plain_id("conv_id")).withColumn("utterance_id", F.col("utterance_id").cast("string"))
    return keyed.join(features, ["conversation_id", "utterance_id"])


def numeric_columns(rows: DataFrame, exclude: list[str]) -> list[str]:
    """Columns of numbers, in the table's order, but for those named."""
    return [f.name for f in rows.schema.fields if isinstance(f.dataType, NumericType) and f.name not in exclude]


def against_target(rows: DataFrame, target: str, columns: list[str], least: int = 10) -> DataFrame:
    """(proxy, spearman, pearson, n, spearman_p, pearson_p, rank) of each column with the target, strongest first.

    All columns are correlated in one plan, each over the rows where neither is null; columns with fewer than `least` are left
    out. Rank is by the size of Spearman's, then by name; null ones come last.
    """
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("proxy"), F.col(target).cast("double").alias("x"), F.col(c).cast("double").alias("y")) for c in columns)))
    out = correlations(rows.select(cells), "proxy", least=least)
    # A row a column.
    return out.withColumn("rank", F.row_number().over(Window.orderBy(F.abs("spearman").desc_nulls_last(), "proxy")))


def proxies(features: DataFrame, targets: DataFrame, on: list[str], target: str, exclude: list[str], only: DataFrame | None = None, least: int = 10) -> DataFrame:
    """`against_target` of the numeric columns of features after a join with targets; `only`: keys of the pairs that count."""
    columns = numeric_columns(features, [*exclude, *on, target])
    rows = features.join(targets.select(*on, target), on)
    return against_target(rows if only is None else rows.join(only, only.columns, "left_semi"), target, columns, least)


def matrix(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """(a, b, pearson, spearman, n): every pair of columns, over rows without a null; keys tell rows apart.

    All columns are ranked in one pass, by column; one more pass takes the moments of all values and ranks together. A
    column that does not vary correlates with none: NaN, as in other engines.
    """
    clean = rows.select(*keys, *(F.col(c).cast("double").alias(c) for c in columns)).na.drop(subset=columns)
    long = clean.select(*keys, F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in columns))))
    cells = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    ranked = long.join(average_ranks(cells, "value", "column"), ["column", "value"])
    wide = ranked.groupBy(*keys).agg(*(F.max(F.when(F.col("column") == c, F.struct("value", "value_rank"))).alias(f"c{i}") for i, c in enumerate(columns)))
    pairs = list(itertools.combinations(range(len(columns)), 2))
    spread = lambda i, j, v: F.sqrt(F.var_pop(f"c{i}.{v}") * F.var_pop(f"c{j}.{v}"))
    both = lambda i, j, v: F.when(F.count("*") > 0, F.coalesce(F.try_divide(F.covar_pop(f"c{i}.{v}", f"c{j}.{v}"), spread(i, j, v)), F.lit(float("nan"))))
    moments = wide.agg(F.count("*").alias("n"), *(both(i, j, v).alias(f"{v}_{i}_{j}") for i, j in pairs for v in ("value", "value_rank")))
    held = F.array(*(F.struct(F.lit(columns[i]).alias("a"), F.lit(columns[j]).alias("b"), F.round(f"value_{i}_{j}", 6).alias("pearson"), F.round(f"value_rank_{i}_{j}", 6).alias("spearman")) for i, j in pairs))
    return moments.select("n", F.inline(held)).select("a", "b", "pearson", "spearman", "n")


def balanced_folds(rows: DataFrame, group: str, folds: int) -> DataFrame:
    """(group, fold): each group in one fold, large groups first and in turns, forth and back, so that folds have like sizes."""
    sizes = rows.where(F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"))
    # Of equal groups a hash tells which comes first.
    order = -F.col("n") + F.pmod(F.xxhash64(group), F.lit(1 << 20)) / float(1 << 20)
    turn = F.pmod("place", F.lit(2 * folds))
    placed = numbered(sizes.select(group, order.alias("order")), "order", "place")
    return placed.select(group, F.when(turn < folds, turn).otherwise(2 * folds - 1 - turn).cast("int").alias("fold"))


def evaluate_proxies(rows: DataFrame, target: str, columns: list[str], group: str, length: str | None = None, folds: int = 5, least: int = 5) -> DataFrame:
    """(proxy, n, spearman, kendall, mae, rmse, nmae, spearman_folds, mae_folds): how columns that stand for the target follow it.

    With a length, ranks are compared with what a line on the length leaves of the target, errors with the target itself. The
    normalised error is over the target's range. Means over folds keep a group's rows together. Rows with a null target or
    column are left out of that column, and columns with fewer than `least` rows altogether.
    """
    y = F.col(target).cast("double")
    base = y
    rows = rows.join(balanced_folds(rows, group, folds), group)
    if length:
        m = Moments(rows, target, [length])
        at, slopes, _ = m.fit([length])
        base = y - F.lit(at) - F.lit(float(slopes[0])) * F.col(length).cast("double") if m.n >= 3 else y
    cells = F.inline(F.array(*(F.struct(F.lit(c).alias("proxy"), base.alias("x"), F.col(c).cast("double").alias("y"), y.alias("truth")) for c in columns)))
    long = rows.select("fold", cells).na.drop(subset=["x", "y"])
    error = F.col("truth") - F.col("y")
    g = long.groupBy("proxy").agg(F.count("*").alias("n"), F.avg(F.abs(error)).alias("mae"), F.sqrt(F.avg(error * error)).alias("rmse"), (F.max("truth") - F.min("truth")).alias("span")).where(F.col("n") >= least)
    by_fold = long.groupBy("proxy", "fold").agg(F.avg(F.abs(error)).alias("mae")).join(correlations(long, "proxy", "fold", least=2).select("proxy", "fold", "spearman"), ["proxy", "fold"], "left")
    folded = by_fold.groupBy("proxy").agg(F.avg("spearman").alias("spearman_folds"), F.avg("mae").alias("mae_folds"))
    out = g.join(correlations(long, "proxy", least=least).select("proxy", "spearman"), "proxy", "left").join(kendall(long, "proxy"), "proxy", "left").join(folded, "proxy", "left")
    return out.select("proxy", "n", "spearman", F.col("tau").alias("kendall"), *(F.round(c, 6).alias(c) for c in ("mae", "rmse")), F.round(F.try_divide(F.col("mae"), F.col("span")), 6).alias("nmae"), F.round("spearman_folds", 6).alias("spearman_folds"), F.round("mae_folds", 6).alias("mae_folds"))


def compare_features(rows: DataFrame, keys: list[str], target: str, features: list[str], group: str, folds: int = 5, seed: int = 0) -> DataFrame:
    """A row a feature: its own rank correlation and error, its slope beside the others, and what is lost without or in place of it.

    spearman and mae: of the column as it is with the target; standard_slope: least squares on standardised columns;
    partial_spearman: rank correlation of what the other features leave of the target and of the feature; drop_spearman and
    rise_mae: means over folds of what ridge regression loses on a left-out fold when the feature's values are shuffled there;
    shapley_r2: its share of the explained variance. Missing features are replaced by their median (approximate); rows
    without a target or any feature are left out. Groups stay in one fold. A shuffle is a join of two orders by place.
    """
    names = [f"v{i + 1}" for i in range(len(features))]
    rows = rows.select(F.xxhash64(*keys).alias("row"), F.col(group).alias("group"), F.col(target).cast("double").alias("v0"), *(F.col(f).cast("double").alias(n) for f, n in zip(features, names, strict=True)))
    rows = rows.where(F.col("v0").isNotNull() & F.coalesce(*names).isNotNull())
    pair = lambda of: F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), *of(i)) for i, f in enumerate(features))))
    single = rows.select(pair(lambda i: (F.col("v0").alias("x"), F.col(names[i]).alias("y"))))
    alone = correlations(single, "feature", least=5).select("feature", "spearman").join(single.na.drop().groupBy("feature").agg(F.avg(F.abs(F.col("x") - F.col("y"))).alias("mae")), "feature")
    middles = rows.agg(*(F.percentile_approx(n, 0.5, 100_000) for n in names)).first()
    filled = rows.na.fill({n: float(m) for n, m in zip(names, middles, strict=True) if m is not None})
    data = filled.join(balanced_folds(filled, "group", folds), "group").select("row", "fold", "v0", *names).persist()
    m = Moments(data, "v0", names)
    slopes, shares = m.fit(names)[1], m.shapley()

    def left(at: str, others: list[str]):
        """What least squares on the others leaves of a column."""
        where = [0, *(names.index(o) + 1 for o in others)]
        i = 0 if at == "v0" else names.index(at) + 1
        w = np.linalg.lstsq(m.products[np.ix_(where[1:], where[1:])], m.products[where[1:], i], rcond=None)[0] if others else np.zeros(0)
        return F.col(at) - float(m.means[i]) - sum((F.lit(float(b)) * (F.col(o) - float(m.means[k])) for b, o, k in zip(w, others, where[1:], strict=True)), F.lit(0.0))

    rest = lambda i: [n for n in names if n != names[i]]
    partial = correlations(data.select(pair(lambda i: (left("v0", rest(i)).alias("x"), left(names[i], rest(i)).alias("y")))), "feature", least=5).select("feature", F.col("spearman").alias("partial_spearman"))
    lost = _shuffled(data, names, folds, seed)
    out = [(f, float(slopes[i] * math.sqrt(m.products[i + 1, i + 1] / m.products[0, 0])) if m.products[0, 0] else None, float(shares[names[i]]), *lost[i]) for i, f in enumerate(features)]
    frame = rows.sparkSession.createDataFrame(out, "feature string, standard_slope double, shapley_r2 double, drop_spearman double, rise_mae double")
    result = frame.join(alone, "feature", "left").join(partial, "feature", "left").select("feature", "spearman", F.round("mae", 6).alias("mae"), F.round("standard_slope", 6).alias("standard_slope"), "partial_spearman", *(F.round(c, 6).alias(c) for c in ("drop_spearman", "rise_mae", "shapley_r2")))
    return result


def _shuffled(data: DataFrame, names: list[str], folds: int, seed: int) -> list[tuple[float | None, float | None]]:
    """Per feature, mean loss in rank correlation and mean rise in absolute error over folds, for ridge fits without each fold."""
    size = len(names) + 1
    pairs = list(itertools.combinations_with_replacement(range(size), 2))
    sums = {}
    for r in data.groupBy("fold").agg(F.count("*"), *(F.sum(f"v{i}") for i in range(size)), *(F.sum(F.col(f"v{i}") * F.col(f"v{j}")) for i, j in pairs)).collect():  # a row a fold
        products = np.zeros((size, size))
        for (i, j), s in zip(pairs, r[2 + size :], strict=True):
            products[i, j] = products[j, i] = s
        sums[r[0]] = (r[1], np.array(r[2 : 2 + size]), products)
    fits = {}
    for f in sums:
        others = [v for k, v in sums.items() if k != f]
        if others:
            n, total, products = (sum(v[i] for v in others) for i in range(3))
            w = _slopes(products - np.outer(total, total) / n, n, "ridge")
            fits[f] = (float(total[0] / n - w @ (total[1:] / n)), [float(x) for x in w])
    if not fits:
        return [(None, None)] * len(names)
    lines = data.sparkSession.createDataFrame([(f, a, w) for f, (a, w) in fits.items()], "fold int, a double, w array<double>")
    share = lambda *salt: F.col("fold") + F.pmod(F.xxhash64("row", *map(F.lit, salt)), F.lit(1 << 40)) / float(1 << 40)
    plain = numbered(data.withColumn("order", share()), "order", "place").drop("order")
    other = numbered(data.select(share(seed + 1).alias("order"), *(F.col(n).alias(f"o{i}") for i, n in enumerate(names))), "order", "place").drop("order")
    both = plain.join(other, "place").join(F.broadcast(lines), "fold")  # a row a fold
    base = F.col("a") + sum((F.col("w")[i] * F.col(n) for i, n in enumerate(names)), F.lit(0.0))
    guesses = [("", base)] + [(n, base + F.col("w")[i] * (F.col(f"o{i}") - F.col(n))) for i, n in enumerate(names)]
    long = both.select("fold", F.inline(F.array(*(F.struct(F.lit(n).alias("moved"), F.col("v0").alias("x"), g.alias("y")) for n, g in guesses))))
    errors = {(r[0], r[1]): r[2] for r in long.groupBy("fold", "moved").agg(F.avg(F.abs(F.col("x") - F.col("y")))).collect()}
    ranks = {(r.fold, r.moved): r.spearman for r in correlations(long, "fold", "moved", least=2).collect()}
    mean = lambda values: float(np.mean(values)) if values else None
    known = lambda f, n: ranks.get((f, "")) is not None and ranks.get((f, n)) is not None
    return [(mean([ranks[f, ""] - ranks[f, n] for f in fits if known(f, n)]), mean([errors[f, n] - errors[f, ""] for f in fits if (f, n) in errors])) for n in names]
