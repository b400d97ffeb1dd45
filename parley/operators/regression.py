"""Least squares from one pass of sums, nested models, shares of explained variance, imputation and scaling."""

from __future__ import annotations

import itertools
import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.operators.metrics import f_probability
from parley.operators.numbering import median


class Moments:
    """Sums of products of a target and a few features over rows without a null among them; the size is that of the features."""

    def __init__(self, rows: DataFrame, target: str, features: list[str]):
        self.features = list(features)
        full = rows.select(*(F.col(c).cast("double").alias(f"v{i}") for i, c in enumerate([target, *features]))).na.drop()
        size = len(features) + 1
        means = full.agg(F.count("*"), *(F.avg(f"v{i}") for i in range(size))).first()
        self.n, self.means = means[0], np.array([m or 0.0 for m in means[1:]])
        pairs = list(itertools.combinations_with_replacement(range(size), 2))
        at = lambda i: F.col(f"v{i}") - float(self.means[i])
        sums = full.agg(*(F.sum(at(i) * at(j)) for i, j in pairs)).first()
        self.products = np.zeros((size, size))
        for (i, j), s in zip(pairs, sums, strict=True):
            self.products[i, j] = self.products[j, i] = s or 0.0

    def fit(self, features: list[str]) -> tuple[float, np.ndarray, float]:
        """Intercept, slopes and residual sum of squares; of collinear features the shortest slopes."""
        at = [self.features.index(f) + 1 for f in features]
        slopes = np.linalg.lstsq(self.products[np.ix_(at, at)], self.products[at, 0], rcond=None)[0] if at else np.zeros(0)
        left = self.products[0, 0] - slopes @ self.products[at, 0]
        return float(self.means[0] - slopes @ self.means[at]), slopes, float(max(0.0, left))

    def r2(self, features: list[str]) -> float:
        return 1 - self.fit(features)[2] / self.products[0, 0] if self.products[0, 0] else 0.0

    def nested(self, small: list[str], large: list[str]) -> tuple[float | None, float | None]:
        """F statistic of the features that `large` adds to `small`, and its probability; none without residual or freedom."""
        added, freedom = len(large) - len(small), self.n - len(large) - 1
        left = self.fit(large)[2]
        if added <= 0 or freedom <= 0 or left <= 0:
            return None, None
        f = (self.fit(small)[2] - left) / added / (left / freedom)
        return f, f_probability(f, added, freedom)

    def shapley(self) -> dict[str, float]:
        """Each feature's gain in explained variance, averaged over all orders in which features may enter."""
        k, out = len(self.features), {}
        known = {s: self.r2(list(s)) for m in range(k + 1) for s in itertools.combinations(self.features, m)}
        for f in self.features:
            rest = [s for s in known if f not in s]
            weigh = lambda s: math.factorial(len(s)) * math.factorial(k - len(s) - 1) / math.factorial(k)
            out[f] = sum(weigh(s) * (known[tuple(x for x in self.features if x in s or x == f)] - known[s]) for s in rest)
        return out


def report(rows: DataFrame, target: str, features: list[str]) -> DataFrame:
    """A row a feature: slope, slope of standardised columns, gain over the model without it (F and its probability), Shapley share."""
    m = Moments(rows, target, features)
    slopes, shares, out = m.fit(features)[1], m.shapley(), []
    for i, f in enumerate(features):
        scale = math.sqrt(m.products[i + 1, i + 1] / m.products[0, 0]) if m.products[0, 0] else 0.0
        gain, p = m.nested([x for x in features if x != f], features)
        out.append((f, float(slopes[i]), float(slopes[i] * scale), gain, p, float(shares[f]), m.n))
    return rows.sparkSession.createDataFrame(out, "feature string, slope double, standard_slope double, f double, p double, shapley_r2 double, n long")


def simple(pairs: DataFrame, *by: str) -> DataFrame:
    """Regression of `y` on `x` by group."""
    return pairs.groupBy(*by).agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"), F.regr_count("y", "x").alias("n"))


def residuals(pairs: DataFrame, keys: list[str], *by: str) -> DataFrame:
    """What the group's regression on `x` leaves of `y`; null where the group has no slope."""
    fitted = pairs.groupBy(*by).agg(F.regr_slope("y", "x").alias("slope"), F.regr_intercept("y", "x").alias("intercept"))
    return pairs.join(fitted, list(by)).select(*keys, F.round(F.col("y") - F.col("slope") * F.col("x") - F.col("intercept"), 6).alias("residual"))


def standardise(rows: DataFrame, keys: list[str], columns: list[str]) -> DataFrame:
    """Columns with nulls replaced by the median, less their mean, over their population deviation; a constant column gives 0."""
    middles = {c: median(rows, c) for c in columns}
    filled = rows.select(*keys, *(F.coalesce(F.col(c).cast("double"), F.lit(middles[c])).alias(c) for c in columns))
    spread = filled.agg(*(f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.stddev_pop, "sd"))))
    return filled.join(F.broadcast(spread)).select(*keys, *(F.round(F.coalesce(F.try_divide(F.col(c) - F.col(f"{c}_mean"), F.col(f"{c}_sd")), F.lit(0.0)), 6).alias(c) for c in columns))
