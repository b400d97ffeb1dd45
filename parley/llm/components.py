"""Connected components of a distributed list of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import scratch


def components(links: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node that has a link; root is the smallest node that it reaches.

    Alternates large-star and small-star contraction: every round hangs a node's neighbours below the smallest one seen,
    so that paths shorten by half or more, and ends when a round changes nothing. Each round's links are a table in the
    shared folder. Links with a null end and links of a node to itself are left out; an empty list gives an empty result.
    """
    own = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u != v")
    edges, seen = scratch.write_and_read(own.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links"), None
    for _ in range(max_rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(down.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct()
        after = scratch.write_and_read(small, "links")
        state = after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.discard(edges)
        edges = after
        if state == seen:
            break
        seen = state
    else:
        raise RuntimeError(f"no end after {max_rounds} rounds")
    scratch.sweep(links.sparkSession)
    star = edges.groupBy("u").agg(F.min("v").alias("root")).select(F.col("u").alias("node"), "root")
    return star.unionByName(star.select(F.col("root").alias("node"), "root").distinct())
