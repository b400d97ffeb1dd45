"""Rank and product-moment correlation, paired tests, and probabilities of test statistics."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.operators.metrics import t_probabilities


def average_ranks(cells: DataFrame, column: str, *by: str, parts: int = 256) -> DataFrame:
    """Average rank within the group of each value of `column`, from rows with a count `n`.

    Values are dealt to `parts` ranges between their own approximate quantiles; a rank is the count of all earlier
    ranges and the running count within its own. So no task sorts a whole group, and the quantiles need not be exact.
    """
    values = cells.groupBy(*by, column).agg(F.sum("n").alias("n"))
    cuts = values.groupBy(*by).agg(F.percentile_approx(column, [k / parts for k in range(1, parts)]).alias("cuts"))
    dealt = values.join(cuts, list(by)).select(*by, column, "n", F.size(F.filter("cuts", lambda c: c < F.col(column))).alias("part"))
    before = F.coalesce(F.sum("s").over(Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = dealt.groupBy(*by, "part").agg(F.sum("n").alias("s")).select(*by, "part", before.alias("offset"))
    upto = F.sum("n").over(Window.partitionBy(*by, "part").orderBy(column))
    ranked = dealt.select(*by, "part", column, "n", upto.alias("upto")).join(offsets, [*by, "part"])
    return ranked.select(*by, column, (F.col("offset") + F.col("upto") - (F.col("n") - 1) / 2).alias(f"{column}_rank"))


def correlations(pairs: DataFrame, *by: str, least: int = 10) -> DataFrame:
    """Spearman's and Pearson's correlation of `x` and `y` by group, with two-sided probabilities.

    Rows with a null are left out, and groups of fewer than `least` rows. A constant side gives nulls. Equal pairs are
    counted first, so what is ranked and joined are distinct pairs.
    """
    cells = pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by, "x", "y").agg(F.count("*").alias("n"))
    ranked = cells.join(average_ranks(cells, "x", *by), [*by, "x"]).join(average_ranks(cells, "y", *by), [*by, "y"])
    n = F.col("n")
    sides = {"spearman": ("x_rank", "y_rank"), "pearson": ("x", "y")}
    sums = [F.sum(n * F.col(a) * (F.col(b) if b else 1)).cast("double").alias(f"{k}_{i}") for k, (x, y) in sides.items() for i, (a, b) in enumerate(((x, None), (y, None), (x, x), (y, y), (x, y)))]
    # Sums of a constant that is no binary fraction leave a little that is no spread.
    varies = ((F.min("x") < F.max("x")) & (F.min("y") < F.max("y"))).alias("varies")
    g = ranked.groupBy(*by).agg(F.sum("n").alias("n"), varies, *sums).where(n >= least)

    def r(kind: str):
        sx, sy, sxx, syy, sxy = (F.col(f"{kind}_{i}") for i in range(5))
        spread = F.sqrt(F.greatest(n * sxx - sx * sx, F.lit(0.0))) * F.sqrt(F.greatest(n * syy - sy * sy, F.lit(0.0)))
        return F.when(F.col("varies"), F.try_divide(n * sxy - sx * sy, spread))

    g = g.select(*by, "n", *(r(k).alias(k) for k in sides))
    t = lambda k: F.when(F.abs(k) >= 1, F.lit(float("inf"))).otherwise(F.col(k) * F.sqrt((n - 2) / (1 - F.col(k) * F.col(k))))
    return g.select(*by, F.round("spearman", 6).alias("spearman"), F.round("pearson", 6).alias("pearson"), "n", *(t_probabilities(t(k), (n - 2).cast("double")).alias(f"{k}_p") for k in sides))


def paired_t(pairs: DataFrame, *by: str) -> DataFrame:
    """Paired t-test of `x` less `y` by group: mean difference, t, count and two-sided probability.

    Rows with a null are left out; fewer than two rows, or differences that do not vary, give a null t.
    """
    d = F.col("x") - F.col("y")
    g = pairs.where("x IS NOT NULL AND y IS NOT NULL").groupBy(*by).agg(F.avg(d).alias("difference"), F.try_divide(F.avg(d), F.stddev_samp(d) / F.sqrt(F.count("*"))).alias("t"), F.count("*").alias("n"))
    return g.select(*by, F.round("difference", 6).alias("difference"), F.round("t", 5).alias("t"), "n", t_probabilities("t", (F.col("n") - 1).cast("double")).alias("p"))


def chi_square_probability(x: float | None, freedom: float | None) -> float | None:
    """Probability of a chi-square statistic at least this large, by the series of the lower incomplete gamma function or,
    beyond it, by the continued fraction of the upper one."""
    if x is None or not freedom or math.isnan(x):
        return None
    a, z = freedom / 2, x / 2
    if z <= 0:
        return 1.0
    scale = math.exp(a * math.log(z) - z - math.lgamma(a))
    if z < a + 1:
        term = total = 1 / a
        k = a
        while term > total * 1e-16:
            k += 1
            term *= z / k
            total += term
        return max(0.0, 1 - scale * total)
    value = 0.0
    for i in range(300, 0, -1):
        value = i * (i - a) / (z + 2 * i + 1 - a - value)
    return scale / (z + 1 - a - value)


def likelihood_ratio(small: float, large: float, added: int) -> tuple[float, float | None]:
    """Twice the gain in log-likelihood of the larger of two nested models, and its chi-square probability."""
    gain = 2 * (large - small)
    return gain, chi_square_probability(gain, added)
