"""Queries over cross-validated models, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from parley.operators import models, trees
from parley.registry import register
from parley.sources.tables import ratings, with_views


def _items(spark, sf):
    """Items with the largest rating of each aspect, a length and one of ten folds."""
    of = lambda a: F.max(F.when(F.col("aspect") == a, F.col("rating")))
    wide = ratings(spark, sf).groupBy("conv_id", "utterance_id").agg(of("A").alias("info"), of("N").alias("novo"), of("R").alias("relv"))
    return wide.selectExpr("conv_id", "utterance_id", "info", "novo", "relv", "utterance_id % 17 AS length", "(conv_id * 31 + utterance_id) % 10 AS fold")


_ITEMS = "SELECT (conv_id * 31 + utterance_id) % 10 AS fold, CAST(max(rating) FILTER (aspect = 'A') AS DOUBLE) AS y, CAST(max(rating) FILTER (aspect = 'N') AS DOUBLE) AS x FROM ratings GROUP BY conv_id, utterance_id HAVING y IS NOT NULL AND x IS NOT NULL"
register("fold_errors", lambda s, d: models.fold_errors(_items(s, d), "info", ["novo"], "fold", ("linear",)), with_views(f"""SELECT 'linear' AS model, CAST(fold AS INT) AS fold, round(sqrt(avg((y - a - b * x) ** 2)), 6) AS rmse, round(avg(abs(y - a - b * x)), 6) AS mae, round(1 - sum((y - a - b * x) ** 2) / (var_pop(y) * count(*)), 6) AS r2, count(*) AS n
    FROM ({_ITEMS}) JOIN (SELECT f.fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM ({_ITEMS}) i JOIN (SELECT unnest(range(10)) AS fold) f ON i.fold <> f.fold GROUP BY 1) USING (fold) GROUP BY 2""", "ratings"))
# Without SQL: tested against numpy.
register("model_sweep", lambda s, d: models.sweep(_items(s, d), "info", ["length"], ["length", "novo", "relv"], "fold"))
register("ordinal_report", lambda s, d: models.ordinal_report(_items(s, d), "info", {"length": ["length"], "full": ["length", "novo", "relv"]}, 4, "fold", 10))
_KEYS = ["conv_id", "utterance_id"]
register("forest_report", lambda s, d: trees.forest_report(_items(s, d), "info", ["length"], ["novo", "relv"], "fold", _KEYS, [1, 2, 3, 4], trees=20, depth=4))
register("forest_importance", lambda s, d: trees.permutation_importance(_items(s, d), "info", ["length", "novo", "relv"], "fold", _KEYS, [1, 2, 3, 4], trees=20, depth=4, repeats=5))
register("tree_errors", lambda s, d: trees.tree_errors(_items(s, d), "info", ["length", "novo", "relv"], "fold", _KEYS, trees=20, rounds=10, depth=2))
