"""The engine's entities, derived from the test tables; `SQL` has the same views for another engine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tidy ratings: one row per (conv_id, utterance_id, aspect, rater_id), 1 to 4."""
    rated = table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 20).alias("conv_id"),
        (F.col("l_orderkey") % 200).alias("utterance_id"),
        F.col("l_returnflag").alias("aspect"),
        F.col("l_linenumber").alias("rater_id"),
        (F.col("l_quantity").cast("int") % 4 + 1).alias("rating"),
    )
    return rated.groupBy("conv_id", "utterance_id", "aspect", "rater_id").agg(F.max("rating").alias("rating"))


def order_ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings whose conversations grow in number with the table: an order is an utterance, a hundred in a row a conversation."""
    rated = table(spark, sf_dir, "lineitem").selectExpr("l_orderkey div 100 AS conv_id", "l_orderkey % 100 AS utterance_id", "l_returnflag AS aspect", "l_linenumber AS rater_id", "CAST(l_quantity AS INT) % 4 + 1 AS rating")
    return rated.groupBy("conv_id", "utterance_id", "aspect", "rater_id").agg(F.max("rating").alias("rating"))


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Model ratings: each item's largest rating, moved by model, run and context."""
    item = ratings(spark, sf_dir).groupBy("conv_id", "utterance_id", "aspect").agg(F.max("rating").alias("top"))
    grid = F.explode(F.expr("flatten(transform(array('m0','m1','m2'), (m, i) -> transform(array('full','short'), (c, j) -> named_struct('model', m, 'context', c, 'shift', i + j))))"))
    runs = item.select("*", grid.alias("g")).select("conv_id", "utterance_id", "aspect", "top", "g.*", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("run"))
    moved = (F.col("top") + F.pmod(F.col("utterance_id") * 7 + F.col("conv_id") * 3 + F.col("run") * 5 + F.col("shift"), F.lit(3)) - 1).cast("int")
    return runs.select("conv_id", "utterance_id", "aspect", "model", "context", "run", F.least(F.lit(4), F.greatest(F.lit(1), moved)).alias("rating"))


def utterances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("idx"), "role", "text")


def acts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as turns: a user is a conversation, an error is the moderator's act, the value an outcome."""
    order = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
    return table(spark, sf_dir, "events").selectExpr("user_id AS conv_id", f"{order} AS idx", "event_type = 'error' AS is_mod", "event_type AS act", "value")


#: SQL of `order_ratings`, under the name that queries over ratings read.
ORDER_RATINGS = "WITH ratings AS (SELECT l_orderkey // 100 AS conv_id, l_orderkey % 100 AS utterance_id, l_returnflag AS aspect, l_linenumber AS rater_id, max(CAST(trunc(l_quantity) AS INT) % 4 + 1) AS rating FROM lineitem GROUP BY 1, 2, 3, 4) "
SQL = {
    "ratings": "SELECT l_suppkey % 20 AS conv_id, l_orderkey % 200 AS utterance_id, l_returnflag AS aspect, l_linenumber AS rater_id, max(CAST(trunc(l_quantity) AS INT) % 4 + 1) AS rating FROM lineitem GROUP BY 1, 2, 3, 4",
    "preds": """SELECT conv_id, utterance_id, aspect, model, context, run, least(4, greatest(1, CAST(top + (utterance_id * 7 + conv_id * 3 + run * 5 + i + j) % 3 - 1 AS INT))) AS rating
        FROM (SELECT conv_id, utterance_id, aspect, max(rating) AS top FROM ratings GROUP BY 1, 2, 3), (VALUES ('m0', 0), ('m1', 1), ('m2', 2)) a(model, i), (VALUES ('full', 0), ('short', 1)) b(context, j), (VALUES (0), (1), (2)) c(run)""",
    "utterances": "SELECT conv_id, turn AS idx, role, text FROM conversations",
    "acts": "SELECT user_id AS conv_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS idx, event_type = 'error' AS is_mod, event_type AS act, value FROM events",
}


def with_views(query: str, *names: str) -> str:
    """SQL over the named views."""
    needed = [n for n in SQL if n in names or (n == "ratings" and "preds" in names)]
    return "WITH " + ", ".join(f"{n} AS ({SQL[n]})" for n in needed) + " " + query
