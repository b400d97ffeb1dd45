"""What follows a moderator's turn: as-of features, lift and lag curves."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def previous_act(acts: DataFrame) -> DataFrame:
    """For each participant's turn the last moderator turn at or before it: its place, value and the lag.

    A window over the conversation carries the last moderator turn forward, so no range join is needed.
    """
    so_far = Window.partitionBy("conv_id").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last(F.when(F.col("is_mod"), F.struct("idx", "value")), ignorenulls=True).over(so_far)
    return acts.select("*", last.alias("m")).where("not is_mod").select("conv_id", "idx", "act", "value", F.col("m.idx").alias("mod_idx"), F.col("m.value").alias("mod_value"), (F.col("idx") - F.col("m.idx")).alias("lag"))


def lag_curves(acts: DataFrame, longest: int = 5) -> DataFrame:
    """Mean outcome and its standard error by act and lag."""
    near = previous_act(acts).where(F.col("lag").between(1, longest))
    sem = F.when(F.count("*") > 1, F.stddev_samp("value") / F.sqrt(F.count("*")))
    return near.groupBy("act", "lag").agg(F.round(F.avg("value"), 6).alias("mean_value"), F.round(sem, 6).alias("sem"), F.count("*").alias("n"))


def act_lift(acts: DataFrame, longest: int = 5) -> DataFrame:
    """Outcome after a near moderator turn less that of all other turns, by act, with Welch's t."""
    marked = previous_act(acts).select("act", "value", F.coalesce(F.col("lag") <= longest, F.lit(False)).alias("near"))
    on, off = F.when(F.col("near"), F.col("value")), F.when(~F.col("near"), F.col("value"))
    g = marked.groupBy("act").agg(F.avg(on).alias("a"), F.avg(off).alias("b"), F.var_samp(on).alias("va"), F.var_samp(off).alias("vb"), F.count(on).alias("na"), F.count(off).alias("nb"))
    t = F.try_divide(F.col("a") - F.col("b"), F.sqrt(F.try_divide(F.col("va"), F.col("na")) + F.try_divide(F.col("vb"), F.col("nb"))))
    return g.select("act", F.round(F.col("a") - F.col("b"), 6).alias("lift"), F.round(t, 5).alias("welch_t"), F.col("na").alias("n_near"), F.col("nb").alias("n_other"))
