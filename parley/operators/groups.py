"""Groups of rows that links connect."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def connected(links: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node with a link (a, b); root is the least node that it reaches.

    Each round hangs every node and its neighbours below the least of them, so that trees shrink to stars in about as many
    rounds as the logarithm of their depth. A round is checkpointed where the session names a folder for it, and kept in
    memory and on disk elsewhere.
    """
    sc = links.sparkSession.sparkContext
    shared = links.sparkSession.conf.get("spark.checkpoint.dir", None)
    if shared and not sc.getCheckpointDir():
        sc.setCheckpointDir(shared)

    def settled(df: DataFrame) -> DataFrame:
        return df.checkpoint() if sc.getCheckpointDir() else df.persist()

    up = links.where("a != b").select(F.greatest("a", "b").alias("node"), F.least("a", "b").alias("root"))
    edges, before = settled(up.distinct()), None
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("root").alias("node"), F.col("node").alias("root")))
        least = both.groupBy("node").agg(F.min("root").alias("least")).select("node", F.least("node", "least").alias("least"))
        # All neighbours of a node, and the node itself, meet its least neighbour.
        moved = both.join(least, "node").select(F.explode(F.array("node", "root")).alias("node"), F.col("least").alias("root")).where("node != root")
        after = settled(moved.distinct())
        after.count()
        edges.unpersist()
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("node", "root"))).first()
        if state == before:
            return after.groupBy("node").agg(F.min("root").alias("root")).unionByName(after.select(F.col("root").alias("node"), "root").distinct())
        edges, before = after, state
    raise RuntimeError(f"links are not settled after {rounds} rounds")
