"""Which group of tasks a person gets next, how far they are, and how uploads are put together."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def next_group(users: DataFrame, groups: DataFrame, done: DataFrame, target: int = 3) -> DataFrame:
    """For each user the fullest group below `target` participants of which they have done nothing; null if none is left.

    Of equally full groups the lowest id is taken. A user with k groups done finds theirs among the first k + 1 of the
    ranking, so only that many rows meet a user, and the ranking is cut at the longest history.
    """
    known = done.select("user_id", "group_id").distinct()
    history = users.select("user_id").distinct().join(known.groupBy("user_id").agg(F.count("*").alias("k")), "user_id", "left").na.fill(0, ["k"])
    longest = history.agg(F.max("k")).first()[0] or 0
    fullest = groups.where(F.col("n_participants") < target).orderBy(F.desc("n_participants"), "group_id").limit(longest + 1)
    ranking = fullest.select("group_id", F.row_number().over(Window.orderBy(F.desc("n_participants"), "group_id")).alias("place"))
    tries = history.select("user_id", F.explode(F.sequence(F.lit(1), (F.col("k") + 1).cast("int"))).alias("place"))
    free = tries.join(ranking, "place").join(known, ["user_id", "group_id"], "left_anti")
    best = free.groupBy("user_id").agg(F.min_by("group_id", "place").alias("group_id"))
    return users.select("user_id").distinct().join(best, "user_id", "left")


def progress(tasks: DataFrame, done: DataFrame) -> DataFrame:
    """Share of a group's tasks (group_id, task_id) that each user has done (user_id, task_id), for groups they began."""
    sizes = tasks.groupBy("group_id").agg(F.countDistinct("task_id").alias("n_tasks"))
    did = done.select("user_id", "task_id").distinct().join(tasks.select("group_id", "task_id").distinct(), "task_id").groupBy("user_id", "group_id").agg(F.count("*").alias("n_done"))
    return did.join(sizes, "group_id").select("user_id", "group_id", "n_done", "n_tasks", F.round(F.col("n_done") / F.col("n_tasks"), 6).alias("progress"))


def task_type(groups: DataFrame) -> DataFrame:
    """The type with fewer participants of each group (info_cur, info_done, mix_cur, mix_done: arrays, null as empty); `info` if equal."""
    n = lambda kind: sum(F.coalesce(F.size(f"{kind}_{c}"), F.lit(0)) for c in ("cur", "done"))
    sized = groups.select("group_id", *(F.greatest(n(k), F.lit(0)).alias(f"n_{k}") for k in ("info", "mix")))
    return sized.withColumn("task_type", F.when(F.col("n_info") <= F.col("n_mix"), "info").otherwise("mix"))


def upload(tasks: DataFrame) -> DataFrame:
    """Task groups: a conversation's task ids by their last number, ids without one first."""
    number = F.regexp_extract("task_id", r"(\d+)\D*$", 1).try_cast("long")
    ids = F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(number, F.lit(-1)).alias("n"), "task_id"))), lambda t: t["task_id"])
    return tasks.groupBy("conv_id").agg(ids.alias("tasks"), F.count("*").alias("n_tasks"))


def complete(annotations: DataFrame, aspects: list[str]) -> DataFrame:
    """Nested annotations by utterance with whether all aspects are labelled; null labels are none."""
    said = annotations.select("conv_id", "rater_id", F.inline("utterances"))
    keys = F.coalesce(F.map_keys("labels"), F.array().cast("array<string>"))
    return said.select("conv_id", "rater_id", "utterance_id", F.forall(F.array(*map(F.lit, aspects)), lambda a: F.array_contains(keys, a)).alias("complete"))


def best_marks(scores: DataFrame, row: list[str], column: str, value: str, columns: list[str]) -> DataFrame:
    """Scores as a table with a column for each of `columns`, the least of a column in bold as LaTeX text; missing ones are dashes."""
    least = F.min(value).over(Window.partitionBy(column))
    text = F.format_string("%.3f", value)
    cell = F.when(F.col(value) == least, F.concat(F.lit("\\textbf{"), text, F.lit("}"))).otherwise(text)
    return scores.select(*row, column, cell.alias("cell")).groupBy(*row).pivot(column, columns).agg(F.max("cell")).na.fill("-", columns)
