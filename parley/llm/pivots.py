"""Exact top-k search by inner product with a pivot-distance index.

Every vector is keyed by its nearest pivot and its distance to it; the index is a table sorted by that key. Around a pivot
p, the triangle inequality keeps a vector v at |d(q, p) - d(v, p)| from a query q at least, and as
2 q.v = |q|^2 + |v|^2 - |q - v|^2, that bounds the inner product from above. A query starts in its own annulus, expands to
annuli in the order of their bounds, and stops at the first whose bound is below its k-th best score; equal scores are
never missed. All arithmetic on scores is exact: components are whole numbers.

Pivots come from a bounded sample; the index holds every row. Queries go in blocks of bounded size, cut by pivot; the range
of distances that a block can reach around each pivot is a filter on the index's scan.

Vectors that are null or hold a null or non-finite component (also after scaling) take no part; shorter vectors count as
ending in zeros. Scores that do not fit a long are the nearest long,
and equal then. Each row is a candidate for every query but itself,
rows of equal id included. Ties go to the smaller id, null ids last, and then in an arbitrary but fixed order. Rows with a
null id are never queries. Empty tables give no rows; only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import scratch

TOP, SCALE = 5, 256
#: The bounded sample that pivots are fitted on, and how many there are.
SAMPLE, PIVOTS = 2048, 64
#: Vectors of an annulus, and of a piece of the index that a task holds at once.
ANNULUS, PIECE = 256, 32_768
#: Bytes of vectors of a block of queries.
BLOCK_BYTES = 16_000_000
_EXACT, _LONG = 2.0**53, 2**63


def stacked(vectors: list[bytes], dims: int = 0) -> np.ndarray:
    """A row a vector, zeros behind the shorter ones; dims: columns at least."""
    sizes = np.array([len(v) // 8 for v in vectors], dtype=np.int64)
    dims = max([dims, *sizes.tolist()])
    if len(vectors) and (sizes == dims).all():
        return np.frombuffer(b"".join(vectors), dtype=np.float64).reshape(len(vectors), dims)
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : sizes[i]] = np.frombuffer(v, dtype=np.float64)
    return out


def widened(x: np.ndarray, dims: int) -> np.ndarray:
    return x if x.shape[1] == dims else np.hstack((x, np.zeros((len(x), dims - x.shape[1]))))


def distances(x: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    dims = max(x.shape[1], pivots.shape[1])
    x, pivots = widened(x, dims), widened(pivots, dims)
    with np.errstate(all="ignore"):
        return np.sqrt(np.maximum(0, (x**2).sum(axis=1)[:, None] + (pivots**2).sum(axis=1) - 2 * (x @ pivots.T)))


def scaled(vectors: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(vec_id, v): whole components as bytes of doubles; vectors that take no part are left out."""
    own = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("v"))

    def convert(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            ids, out = [], []
            for i, v in enumerate(rows.column("v")):
                if v.is_valid and not v.values.null_count:
                    with np.errstate(all="ignore"):
                        x = np.floor(v.values.to_numpy(zero_copy_only=False).astype(np.float64) * scale)
                    if np.isfinite(x).all():
                        ids.append(i)
                        out.append(x.tobytes())
            yield pa.RecordBatch.from_arrays([rows.column("vec_id").take(pa.array(ids, pa.int64())), pa.array(out, pa.binary())], ["vec_id", "v"])

    return own.mapInArrow(convert, f"vec_id {dict(own.dtypes)['vec_id']}, v binary")


def fit_pivots(sample: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """Means of the sample's clusters: far points first, then a few rounds of k-means."""
    if not len(sample):
        return np.zeros((1, sample.shape[1]))
    chosen, far = [0], np.full(len(sample), np.inf)
    while len(chosen) < min(count, len(sample)):
        far = np.minimum(far, distances(sample, sample[chosen[-1] :][:1])[:, 0])
        if not far.max() > 0:
            break
        chosen.append(int(far.argmax()))
    pivots = sample[chosen].copy()
    for _ in range(rounds):
        near = distances(sample, pivots).argmin(axis=1)
        for k in np.unique(near):
            pivots[k] = sample[near == k].mean(axis=0)
    return pivots


def build(vectors: DataFrame, id_col: str, vector_col: str, scale: float, pivots: int, sample: int) -> tuple[DataFrame, np.ndarray]:
    """The index, a written table (row, vec_id, v, pivot, dist, norm) in the order of its key, and the pivots."""
    spark = vectors.sparkSession
    count = vectors.select(F.count(vector_col)).first()[0]
    place = F.xxhash64(id_col, vector_col) / 2.0**64 + 0.5
    few = scaled(vectors.where(place < (2.0 * sample + 40) / max(1, count)), id_col, vector_col, scale).limit(sample).collect()
    centres = fit_pivots(stacked([bytes(r.v) for r in few]), pivots)
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            if not rows.num_rows:
                continue
            x = stacked(rows.column("v").to_pylist())
            with np.errstate(all="ignore"):
                d, norm = distances(x, shared.value), (x**2).sum(axis=1)
            d = np.where(np.isnan(d), np.inf, d)
            near = d.argmin(axis=1)
            more = [pa.array(near.astype(np.int32)), pa.array(d[np.arange(len(near)), near]), pa.array(norm)]
            yield pa.RecordBatch.from_arrays([*rows.columns, *more], [*rows.schema.names, "pivot", "dist", "norm"])

    keyed = scaled(vectors, id_col, vector_col, scale)
    keyed = keyed.mapInArrow(assign, f"vec_id {dict(keyed.dtypes)['vec_id']}, v binary, pivot int, dist double, norm double")
    keyed = scratch.write_and_read(keyed.withColumn("row", F.monotonically_increasing_id()), "keyed")
    parts = max(1, min(-(-count // 1000), max(spark.sparkContext.defaultParallelism, -(-count // (4 * PIECE)))))
    index = scratch.write_and_read(keyed.repartitionByRange(parts, "pivot", "dist", "row").sortWithinPartitions("pivot", "dist", "row"), "index")
    scratch.discard(keyed)
    return index, centres


@dataclass
class Queries:
    """A block of queries; floors: scores that the k-th best reaches at least."""

    rows: np.ndarray
    x: np.ndarray
    norm: np.ndarray
    dist: np.ndarray
    pivot: np.ndarray
    own: np.ndarray
    floors: np.ndarray


def scores_of(queries: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Exact inner products; in whole numbers of any size where doubles do not hold them."""
    dims = max(queries.shape[1], vectors.shape[1])
    with np.errstate(over="ignore"):
        most = max(1.0, np.abs(queries).max(initial=0)) * max(1.0, np.abs(vectors).max(initial=0))
    queries, vectors = widened(queries, dims), widened(vectors, dims)
    if dims * most < _EXACT:
        return (queries @ vectors.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip((whole(queries) @ whole(vectors).T), -_LONG, _LONG - 1).astype(np.int64)


class Piece:
    """Consecutive rows of the index, cut into annuli: rows of one pivot, next to each other in distance."""

    def __init__(self, rows: pa.Table):
        self.ids = pa.concat_arrays(rows.column("vec_id").chunks) if rows.column("vec_id").num_chunks > 1 else rows.column("vec_id").chunk(0)
        self.row, self.x = rows.column("row").to_numpy(), stacked(rows.column("v").to_pylist())
        self.place = np.empty(len(self.row), dtype=np.int64)
        self.place[np.lexsort((self.row, pc.rank(self.ids, null_placement="at_end", tiebreaker="dense").to_numpy()))] = np.arange(len(self.row))
        pivot, dist, norm = (rows.column(c).to_numpy() for c in ("pivot", "dist", "norm"))
        new = np.flatnonzero(np.diff(pivot, prepend=-1))
        self.begin = np.concatenate([np.arange(a, b, ANNULUS) for a, b in zip(new, [*new[1:], len(pivot)], strict=True)])
        self.end = np.minimum(np.append(self.begin[1:], len(pivot)), self.begin + ANNULUS)
        self.pivot, self.low, self.high = pivot[self.begin], dist[self.begin], dist[self.end - 1]
        self.norm = np.maximum.reduceat(norm, self.begin)

    def bounds(self, q: Queries) -> np.ndarray:
        """No vector of an annulus scores above this, a row a query; infinite where it cannot be said."""
        d = q.dist[:, self.pivot]
        with np.errstate(all="ignore"):
            gap = np.maximum(0, np.maximum(self.low - d, d - self.high) * (1 - 1e-9) - 1e-6)
            out = (q.norm[:, None] + self.norm - gap**2) / 2
            return np.where(np.isfinite(out), out + 1 + 1e-9 * np.abs(out), np.inf)

    def search(self, q: Queries, top: int, home: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, place in this piece, score) of each query's best here that reach its floor. home: in its own annulus only."""
        bound = self.bounds(q)
        if home:
            d = q.own[:, None]
            bound = np.where((self.pivot == q.pivot[:, None]) & (self.low <= d) & (self.high >= d), np.inf, -np.inf)
        order = np.argsort(-bound, axis=1, kind="stable")
        bound = np.take_along_axis(bound, order, axis=1)
        floors = q.floors.astype(np.float64)
        best = (np.zeros(0, dtype=np.int64),) * 3
        at, step, active = 0, 1, np.arange(len(q.rows))
        while at < len(self.begin) and len(active):
            ahead = bound[active, at : at + step]
            wanted = ahead >= floors[active, None] if not home else ahead > 0
            who, which = np.nonzero(wanted)
            annulus, who = order[active[who], at + which], active[who]
            by = np.argsort(annulus, kind="stable")
            found = [best]
            for group in np.split(by, np.flatnonzero(np.diff(annulus[by])) + 1) if len(by) else []:
                a, mine = annulus[group[0]], who[group]
                span = slice(self.begin[a], self.end[a])
                got = scores_of(q.x[mine], self.x[span])
                itself = q.rows[mine][:, None] == self.row[span]
                kth = np.partition(np.where(itself, np.iinfo(np.int64).min, got), -min(top, got.shape[1]), axis=1)[:, -min(top, got.shape[1])]
                least = np.maximum(floors[mine], kth.astype(np.float64)) if got.shape[1] >= top else floors[mine]
                i, j = np.nonzero((got >= least[:, None]) & ~itself)
                found.append((mine[i], j + self.begin[a], got[i, j]))
            query, place, score = (np.concatenate(x) for x in zip(*found, strict=True))
            keep = np.lexsort((self.place[place], -score, query))
            query, place, score = query[keep], place[keep], score[keep]
            first = np.searchsorted(query, query)
            rank = np.arange(len(query)) - first
            keep = rank < top
            query, place, score, rank = query[keep], place[keep], score[keep], rank[keep]
            full = rank == top - 1
            floors[query[full]] = np.maximum(floors[query[full]], score[full])
            best = (query, place, score)
            at, step = at + step, 2 * step
            if at < len(self.begin):
                active = active[bound[active, at] >= floors[active]] if not home else active[bound[active, at] > 0]
        query, place, score = best
        keep = score >= floors[query]
        return query[keep], place[keep], score[keep]


def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[Piece]:
    parts, count = [], 0
    for rows in batches:
        for at in range(0, rows.num_rows, PIECE):
            parts.append(rows.slice(at, PIECE))
            count += parts[-1].num_rows
            if count >= PIECE:
                yield Piece(pa.Table.from_batches(parts).sort_by([("pivot", "ascending"), ("dist", "ascending")]))
                parts, count = [], 0
    if count:
        yield Piece(pa.Table.from_batches(parts).sort_by([("pivot", "ascending"), ("dist", "ascending")]))


def search(index: DataFrame, queries: Queries, top: int, home: bool = False) -> DataFrame:
    """(query, vec_id, row, score): the best of every piece of the index. home: what each query's own annulus gives."""
    shared = index.sparkSession.sparkContext.broadcast(queries)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q = shared.value
        q = Queries(q.rows, q.x, q.norm, q.dist, q.pivot, q.own, q.floors.copy())
        known = np.full((len(q.rows), top), -np.inf)
        for piece in pieces(batches):
            query, place, score = piece.search(q, top, home)
            if not home:  # what this task has found bounds the search of its next piece
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                mine = np.full_like(known, -np.inf)
                mine[query, rank] = score
                known = -np.sort(-np.hstack((known, mine)), axis=1)[:, :top]
                q.floors = np.maximum(q.floors, known[:, -1])
            yield pa.RecordBatch.from_arrays([pa.array(query), piece.ids.take(pa.array(place)), pa.array(piece.row[place]), pa.array(score)], ["query", "vec_id", "row", "score"])
            scratch.tidy()

    return index.mapInArrow(run, f"query long, vec_id {dict(index.dtypes)['vec_id']}, row long, score long")


def reach(q: Queries, norms: dict[int, float]) -> Column | None:
    """Rows of the index that the triangle inequality leaves for a block: a range of distances around each pivot."""
    out = []
    for pivot, norm in norms.items():
        with np.errstate(all="ignore"):
            far = np.sqrt(np.maximum(0, q.norm + norm - 2 * q.floors)) * (1 + 1e-9) + 1e-3
            low, high = (q.dist[:, pivot] - far).min(), (q.dist[:, pivot] + far).max()
        if not (np.isfinite(low) and np.isfinite(high)):
            return None
        out.append((F.col("pivot") == pivot) & F.col("dist").between(float(low), float(high)))
    return reduce(lambda a, b: a | b, out)


def nearest(vectors: DataFrame, is_query: Column, top: int = TOP, id_col: str = "vec_id", vector_col: str = "embedding", scale: float = SCALE, pivots: int = PIVOTS, sample: int = SAMPLE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row where is_query, a condition on vec_id, holds, the `top` other rows of highest score."""
    index, centres = build(vectors, id_col, vector_col, scale, pivots, sample)
    asked = index.where(is_query & F.col("vec_id").isNotNull())
    sizes = asked.groupBy("pivot").agg(F.count("*").alias("n"), F.sum(F.octet_length("v")).alias("b")).orderBy("pivot").collect()
    norms = {r.pivot: r.norm for r in index.groupBy("pivot").agg(F.max("norm").alias("norm")).collect()}
    found = []
    for block in blocks([(r.pivot, r.b + 40 * r.n) for r in sizes], block_bytes):
        chosen = reduce(lambda a, b: a | b, [(F.col("pivot") == p) & (F.pmod(F.xxhash64("row"), F.lit(of)) == k) for p, k, of in block])
        mine = asked.where(chosen).orderBy("row").collect()
        if not mine:
            continue
        x, rows = stacked([bytes(r.v) for r in mine]), np.array([r.row for r in mine])
        own, pivot = np.array([r.dist for r in mine]), np.array([r.pivot for r in mine])
        q = Queries(rows, x, np.array([r.norm for r in mine]), distances(x, centres), pivot, own, np.full(len(rows), -np.inf))
        home = search(index.where(F.col("pivot").isin(sorted({p for p, _, _ in block}))), q, top, home=True)
        rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score")))
        for r in home.withColumn("rank", rank).where(F.col("rank") == top).select("query", "score").collect():
            q.floors[r.query] = r.score
        left = reach(q, norms)
        best = search(index if left is None else index.where(left), q, top)
        order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
        ids = vectors.sparkSession.createDataFrame([(i, r.vec_id) for i, r in enumerate(mine)], f"query long, query_id {dict(index.dtypes)['vec_id']}")
        ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        found.append(scratch.write_and_read(ranked.join(F.broadcast(ids), "query").select("query_id", "rank", "vec_id", "score"), "nearest"))
    if not found:
        kind = dict(index.dtypes)["vec_id"]
        found = [vectors.sparkSession.createDataFrame([], f"query_id {kind}, rank int, vec_id {kind}, score long")]
    scratch.discard(index)
    return reduce(DataFrame.unionByName, found)


def blocks(sizes: list[tuple[int, int]], most: int) -> list[list[tuple[int, int, int]]]:
    """Blocks of (pivot, part, parts): small pivots share a block, large ones are cut by a hash of rows."""
    out, room = [], 0
    for pivot, size in sizes:
        parts = -(-size // most)
        if parts > 1:
            out += [[(pivot, k, parts)] for k in range(parts)]
            room = 0
        elif size <= room:
            out[-1].append((pivot, 0, 1))
            room -= size
        else:
            out.append([(pivot, 0, 1)])
            room = most - size
    return out
