"""Every query with SQL gives the rows that its SQL gives; the others at least run."""

import pytest

from parley import registry
from tests.oracle import compare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, name):
    sql = registry.oracle_sql().get(name)
    if sql:
        compare(spark, registry.queries()[name], sql, SF)
    else:
        assert registry.queries()[name](spark, SF).count() > 0


def test_entry_points():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_ranges_of_ratings_that_all_agree(spark, tmp_path):
    from pyspark.sql import functions as F

    from tests.oracle import TABLES

    for t in TABLES:
        if t != "lineitem":
            (tmp_path / f"{t}.parquet").symlink_to(f"{SF}/{t}.parquet")
    spark.read.parquet(f"{SF}/lineitem.parquet").withColumn("l_quantity", F.lit(3.0)).coalesce(1).write.parquet(str(tmp_path / "lines"))
    next((tmp_path / "lines").glob("*.parquet")).rename(tmp_path / "lineitem.parquet")
    for name in ("human_kappa_range", "model_kappa_range"):
        compare(spark, registry.queries()[name], registry.oracle_sql()[name], str(tmp_path))
