"""Label release, latest states, and memory lookups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def integrated(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Labels as long rows with their source, and a row for each document without any."""
    long = labels.unpivot(["doc_id"], ["quality", "toxic"], "aspect", "label_value").withColumn("label_source", F.lit("human_individual"))
    rest = documents.join(labels, "doc_id", "left_anti").select("doc_id", F.lit(None).cast("string").alias("aspect"), F.lit(None).cast("int").alias("label_value"), F.lit("unlabeled").alias("label_source"))
    return long.unionByName(rest).join(documents.select("doc_id", "lang", "source"), "doc_id", "left")


def source_counts(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return integrated(documents, labels).groupBy("label_source", "lang").agg(F.count("*").alias("n"))


def latest_per_user(events: DataFrame) -> DataFrame:
    """Each user's last event; the first of those at one time."""
    order = Window.partitionBy("user_id").orderBy(F.desc("ts"), "event_id")
    return events.select("user_id", "event_id", "event_type", F.row_number().over(order).alias("rn")).where("rn = 1").drop("rn")


def stale(events: DataFrame, hours: int = 2) -> DataFrame:
    """Users whose last event lies longer before the table's last one than an assignment may take."""
    last = events.groupBy("user_id").agg(F.max("ts").alias("ts"))
    now = events.agg(F.max("ts").alias("now"))
    return last.join(F.broadcast(now)).where(F.expr(f"now - ts > INTERVAL {hours} HOURS")).select("user_id", F.expr("CAST(timestampdiff(SECOND, ts, now) AS BIGINT)").alias("idle_seconds"))


#: Queries and memories of one block that meet in a task.
QUERY_BLOCK, MEMORY_BLOCK = 512, 4096


def vector_top_k(memories: DataFrame, k: int = 5, every: int = 20) -> DataFrame:
    """The `k` memories nearest by cosine to each query of the same run; queries are ids divisible by `every`.

    Each pair of one run is scored once, in blocks of bounded size: of a block of memories a query keeps its `k` best, so that
    only those are sorted. Sums run from the first component to the last. A vector without a length, or null, has a null
    score, which comes last; a pair of unequal lengths has one too.
    """
    m = memories.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v")).where("label is not null")
    queries = m.where(F.col("vec_id") % every == 0)
    # A row a run.
    sizes = m.groupBy("label").agg(F.ceil(F.count("*") / MEMORY_BLOCK).cast("int").alias("parts"), F.ceil(F.count_if(F.col("vec_id") % every == 0) / QUERY_BLOCK).cast("int").alias("asked")).where("asked > 0")
    mine = lambda of, salt: F.pmod(F.xxhash64("vec_id", F.lit(salt)), F.col(of)).cast("int")
    all_of = lambda of: F.explode(F.sequence(F.lit(0), F.col(of) - 1))
    q = queries.join(F.broadcast(sizes), "label").select(F.col("label").alias("of"), mine("asked", 1).alias("a"), all_of("parts").alias("b"), F.col("vec_id").alias("id"), F.col("v").alias("x"))
    c = m.join(F.broadcast(sizes), "label").select(F.col("label").alias("run"), all_of("asked").alias("c"), mine("parts", 2).alias("d"), F.col("vec_id").alias("id"), F.col("v").alias("x"))
    width = lambda t: (t.column("id").to_numpy(), t.column("x").to_pylist())

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        (qid, qv), (mid, mv) = width(asked), width(held)
        out: list[tuple[int, int, float | None]] = []
        if len(qid) and len(mid):
            shape = lambda vs: np.array([len(v) if v is not None and None not in v else -1 for v in vs])
            qn, mn = shape(qv), shape(mv)
            score = np.full((len(qid), len(mid)), np.nan)
            for size in np.intersect1d(qn[qn > 0], mn[mn > 0]):
                i, j = np.flatnonzero(qn == size), np.flatnonzero(mn == size)
                x, y = np.array([qv[t] for t in i]), np.array([mv[t] for t in j])
                dot, nx, ny = np.zeros((len(i), len(j))), np.zeros(len(i)), np.zeros(len(j))
                for d in range(size):
                    dot += x[:, d, None] * y[None, :, d]
                    nx += x[:, d] * x[:, d]
                    ny += y[:, d] * y[:, d]
                whole = np.sqrt(ny)[None, :] * np.sqrt(nx)[:, None]
                score[np.ix_(i, j)] = np.divide(dot, whole, out=np.full_like(dot, np.nan), where=whole > 0)
            # Rounded as the result is, so that equal scores go by id; whatever is near the last one kept goes on.
            near = np.where(np.isnan(score), -np.inf, score)
            near[mid[None, :] == qid[:, None]] = -np.inf
            keep = min(k, len(mid)) - 1
            floor = -np.partition(-near, keep, axis=1)[:, keep] - 2e-5
            for r in range(len(qid)):
                at = np.flatnonzero((near[r] >= floor[r]) & (mid != qid[r])) if np.isfinite(floor[r]) else np.flatnonzero(mid != qid[r])
                out += [(int(qid[r]), int(mid[t]), None if np.isnan(score[r, t]) else float(score[r, t])) for t in at]
        ids, vecs, values = zip(*out, strict=True) if out else ((), (), ())
        return pa.table({"query_id": pa.array(ids, pa.int64()), "vec_id": pa.array(vecs, pa.int64()), "score": pa.array(values, pa.float64())})

    scored = q.groupBy("of", "a", "b").cogroup(c.groupBy("run", "c", "d")).applyInArrow(best, "query_id long, vec_id long, score double").select("query_id", "vec_id", F.round("score", 5).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return scored.select("*", rank.alias("rank")).where(F.col("rank") <= k)


def unique_hits(hits: DataFrame) -> DataFrame:
    """Each memory that any query found, once, with its best score and how many queries found it."""
    return hits.groupBy("vec_id").agg(F.max("score").alias("score"), F.count("*").alias("n_queries"))


def resolve_updates(updates: DataFrame) -> DataFrame:
    """Of several updates of one target the last stands, and none without a target; all other actions do, a null one too."""
    last = F.row_number().over(Window.partitionBy("conv_id", "target", "action").orderBy(F.desc("pos")))
    stands = ~F.col("action").eqNullSafe("UPDATE") | (F.col("target").isNotNull() & (F.col("rn") == 1))
    return updates.withColumn("rn", last).where(stands).drop("rn")
