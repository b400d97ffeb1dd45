"""Consecutive numbers of rows in an order, and exact medians, without a single task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: Values drawn for each range that rows of an order other than of numbers are dealt to.
_DRAWN = 100


def _cuts(rows: DataFrame, order: str, parts: int) -> list:
    """Values that cut the rows into ranges of like size; they bear on speed only."""
    if isinstance(rows.schema[order].dataType, NumericType):
        return sorted(set(rows.select(F.percentile_approx(order, [(k + 1) / parts for k in range(parts - 1)] or [0.5], 10_000)).first()[0] or []))
    known = rows.select(order).where(F.col(order).isNotNull())
    share = min(1.0, 2 * _DRAWN * parts / max(1, known.count()))
    drawn = sorted(r[0] for r in known.sample(share, seed=1).limit(4 * _DRAWN * parts).collect())
    return sorted(set(drawn[len(drawn) // parts :: max(1, len(drawn) // parts)]))


def numbered(rows: DataFrame, order: str, name: str) -> DataFrame:
    """Rows with numbers 0, 1, ... in the order of a column, nulls first; rows of equal value are numbered in some order.

    Rows are dealt by ranges of the column; a row's number is its place in its range and the sizes of the ranges before. The
    ranges are cut at given values, so that both passes agree on them. Rows that share a value are one range's.
    """
    cuts = _cuts(rows, order, rows.sparkSession.sparkContext.defaultParallelism)
    dealt = rows.withColumn("_part", sum((F.coalesce((F.col(order) > F.lit(c)).cast("int"), F.lit(0)) for c in cuts), F.lit(0)))
    sizes = dict(dealt.groupBy("_part").count().collect())  # a row a range
    before, so_far = {}, 0
    for part in sorted(sizes):
        before[part], so_far = so_far, so_far + sizes[part]
    offset = F.element_at(F.create_map(*(F.lit(x) for part, n in before.items() for x in (part, n))), F.col("_part")) if before else F.lit(0)
    own = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_first(order)))
    return dealt.withColumn(name, (own - 1 + offset).cast("long")).drop("_part")


def median(rows: DataFrame, column: str) -> float | None:
    """The exact median of a column of numbers; null without a value."""
    known = rows.select(F.col(column).cast("double").alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))
    cuts = _cuts(known, "v", known.sparkSession.sparkContext.defaultParallelism)
    dealt = known.withColumn("_part", sum(((F.col("v") > c).cast("int") for c in cuts), F.lit(0)))
    sizes = {r[0]: r[1] for r in dealt.groupBy("_part").agg(F.sum("n")).collect()}  # a row a range
    total = sum(sizes.values())
    if not total:
        return None
    before, so_far = {}, 0
    for part in sorted(sizes):
        before[part], so_far = so_far, so_far + sizes[part]
    wanted = sorted({(total - 1) // 2, total // 2})
    held = [p for p in sizes if any(before[p] <= k < before[p] + sizes[p] for k in wanted)]
    offset = F.element_at(F.create_map(*(F.lit(x) for p in held for x in (p, before[p]))), F.col("_part"))
    upto = F.sum("n").over(Window.partitionBy("_part").orderBy("v")) + offset
    # Counts of values in the one or two ranges where the middle lies.
    found = dealt.where(F.col("_part").isin(held)).withColumn("upto", upto)
    at = found.agg(*(F.min(F.when(F.col("upto") > k, F.col("v"))) for k in wanted)).first()
    return float(sum(at) / len(at))
