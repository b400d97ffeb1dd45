"""SimHash near-duplicates by tiled exact comparison.

Fingerprints are compared tile by tile with numpy's exclusive-or and bit counts. A tile holds the distinct fingerprints
whose four 16-bit quarters have the same population counts; two fingerprints differ in at least as many bits as their
quarters' population counts differ, so pairs of tiles further apart than the radius are skipped and no pair within it
is lost. Tiles of more than `tile_rows` fingerprints are split, so that no task gets an unbounded group.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from parley.llm import scratch
from parley.llm.components import components

RADIUS = 2
SHINGLE = 3
TILE_ROWS = 8192
_QUARTERS = (0, 16, 32, 48)
_BLOCK = 1 << 16


def shingle_digests(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of every word shingle of a text, repeats included, in the text's order.

    A-Z are lower-cased and words are runs of bytes other than \\x20 and \\x09-\\x0D. Fewer words than a shingle make one
    shingle of them all; no word (or null) makes none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, dtype=np.uint64)
    digest = xxhash.xxh64_digest
    if len(words) <= shingle:
        parts = iter([b" ".join(words)])
    else:
        parts = map(b" ".join, zip(*(words[i:] for i in range(shingle)), strict=False))
    blocks = []
    while block := list(itertools.islice(parts, _BLOCK)):
        blocks.append(np.frombuffer(b"".join([digest(s, 42) for s in block]), dtype=">u8").astype(np.uint64))
    return np.concatenate(blocks)


def fingerprint_of(digests: np.ndarray) -> int:
    """SimHash as a signed integer: a bit is set if over half the digests have it; none gives zero."""
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(digests), _BLOCK):
        ones += np.unpackbits(digests[at : at + _BLOCK].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(digests)).tobytes(), "big", signed=True) if len(digests) else 0


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text's word shingles, as a signed integer; no word (or null) gives zero."""
    return fingerprint_of(shingle_digests(text, shingle))


def fingerprint_column(shingle: int = SHINGLE):
    """A vectorised function from a text column to its fingerprint as a long; null gives zero."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle) for t in texts], dtype="int64")

    return of


def hex_digits(fingerprint_col):
    """16 lower-case hex digits of a fingerprint column."""
    return F.lower(F.lpad(F.hex(fingerprint_col), 16, "0"))


def _neighbours(radius: int) -> list[tuple[int, ...]]:
    """Differences of the four counts that sum to the radius at most, each pair of tiles once (first difference positive)."""
    steps = [s for s in itertools.product(range(-radius, radius + 1), repeat=4) if sum(map(abs, s)) <= radius]
    return [s for s in steps if next((x for x in s if x), 0) > 0]


def _contract(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Smallest node that each of n nodes reaches over the links i-j."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if np.array_equal(root, before):
            return root


def tile_links(home: np.ndarray, visitors: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what the pairs within the radius connect: home against home, and home against visitors.

    Rather than all pairs, each node gets a link to the smallest one that it reaches, so that a group of copies costs
    as many links as it has members.
    """
    nodes = np.concatenate([home, visitors])
    block = max(1, (4 << 20) // max(1, len(nodes)))

    def near() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for at in range(0, len(home), block):
            i, j = np.nonzero(np.bitwise_count(home[at : at + block, None] ^ nodes[None, :]) <= radius)
            keep = i + at < j
            yield i[keep] + at, j[keep]

    i, j = spanning(len(nodes), near())
    return nodes[j], nodes[i]


def spanning(n: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(i, j): of n nodes, the smallest that each reaches over the pairs, and the node, where those differ."""
    held, count = [], 0
    for i, j in pairs:
        held.append((i, j))
        count += len(i)
        if count > 4 * n + (1 << 20):
            root = _contract(n, *map(np.concatenate, zip(*held, strict=True)))
            own = np.flatnonzero(root != np.arange(n))
            held, count = [(root[own], own)], len(own)
    root = _contract(n, *map(np.concatenate, zip(*held, strict=True))) if count else np.arange(n)
    own = np.flatnonzero(root != np.arange(n))
    return root[own], own


def tile_pairs(prints: np.ndarray, radius: int, tile: int = 1024) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Blocks of (i, j), each pair of fingerprints within the radius once.

    They are put in order of population count and cut into tiles; tiles whose counts differ beyond the radius are skipped.
    """
    counts = np.bitwise_count(prints)
    order = np.argsort(counts, kind="stable")
    prints, counts = prints[order], counts[order].astype(np.int64)
    for a in range(0, len(prints), tile):
        home = prints[a : a + tile]
        for b in range(a, len(prints), tile):
            if counts[b] - counts[min(a + tile, len(prints)) - 1] > radius:
                break
            i, j = np.nonzero(np.bitwise_count(home[:, None] ^ prints[None, b : b + tile]) <= radius)
            keep = i + a < j + b
            yield order[i[keep] + a], order[j[keep] + b]


def near_links(distinct: DataFrame, column: str = "fp", radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(a, b): links between distinct fingerprints that connect all that lie within the radius of each other.

    Every fingerprint stays at home in its own tile and visits the neighbouring tiles that come after it. A tile with
    more than `tile_rows` at home, or 64 times as many visitors, is cut into a grid of pieces; small tiles share tasks.
    """
    counts = [F.bit_count(F.shiftrightunsigned(F.col("fp"), s).bitwiseAND(F.lit(0xFFFF))) for s in _QUARTERS]
    steps = F.array(*(F.lit(sum(s[k] * 32**k for k in range(4))) for s in _neighbours(radius)))
    step_to = lambda: F.explode(F.transform(steps, lambda s: F.col("from") + s)).alias("tile")
    own = distinct.select(F.col(column).cast("long").alias("fp")).where("fp is not null")
    own = own.select("fp", sum((c * 32**k for k, c in enumerate(counts)), F.lit(0)).cast("int").alias("tile"))
    # At most 17**4 rows, however many fingerprints there are.
    sizes = own.groupBy("tile").agg(F.count("*").alias("n"))
    guests = sizes.select(F.col("tile").alias("from"), "n").select(step_to(), "n").groupBy("tile").agg(F.sum("n").alias("guests"))
    grid = sizes.join(guests, "tile", "left").select("tile", F.ceil(F.col("n") / tile_rows).cast("int").alias("rows"), F.ceil(F.greatest(F.coalesce("guests", F.lit(0)), F.lit(1)) / (64 * tile_rows)).cast("int").alias("cols"))
    grid = F.broadcast(scratch.write_and_read(grid, "tiles"))
    bundles = max(1, -(-distinct.count() * (len(_neighbours(radius)) + 1) // (1 << 18)))
    placed = own.join(grid, "tile").withColumn("row", F.pmod(F.xxhash64("fp"), F.col("rows")).cast("int"))
    all_cols = F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col")
    one_col = F.pmod(F.xxhash64("fp", F.lit(1)), F.col("cols")).cast("int").alias("col")
    at_home = placed.select("tile", "row", all_cols, F.lit(True).alias("home"), "fp")
    beside = placed.where("row + 1 < rows").select("tile", F.explode(F.sequence(F.col("row") + 1, F.col("rows") - 1)).alias("row"), one_col, F.lit(False).alias("home"), "fp")
    away = own.withColumnRenamed("tile", "from").select(step_to(), "fp").join(grid, "tile")
    away = away.select("tile", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), one_col, F.lit(False).alias("home"), "fp")

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        key = (rows["tile"].to_numpy().astype(np.int64) << 40) + (rows["row"].to_numpy().astype(np.int64) << 20) + rows["col"].to_numpy()
        order = np.lexsort((~rows["home"].to_numpy(), key))
        key, values, home = key[order], rows["fp"].to_numpy().view(np.uint64)[order], rows["home"].to_numpy()[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        found = [tile_links(values[s : s + k], values[s + k : e], radius) for s, e, k in zip(starts, np.r_[starts[1:], len(key)], np.add.reduceat(home.astype(np.int64), starts), strict=True) if k]
        a, b = (np.concatenate([x[side] for x in found] or [values[:0]]) for side in (0, 1))
        return pd.DataFrame({"a": a.view(np.int64), "b": b.view(np.int64)})

    dealt = at_home.unionByName(beside).unionByName(away).withColumn("bundle", F.pmod(F.xxhash64("tile", "row", "col"), F.lit(bundles)))
    return dealt.groupBy("bundle").applyInPandas(link, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of `docs`.

    Rows link if their fingerprints differ in `radius` bits or fewer; component_id is the smallest id that a row
    reaches over links, its own included. Null, empty and blank texts have fingerprint zero and link like any other.
    Rows that repeat stay as many rows; null ids never become a component_id unless a component has no other. Columns
    of `docs` other than the two named are not read, so they may have any names. No rows give no rows.
    """
    fps = docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(shingle)(F.col(text_col)).alias("fp"))
    fps = scratch.write_and_read(fps, "fingerprints")
    distinct = scratch.write_and_read(fps.groupBy("fp").agg(F.min("doc_id").alias("first")), "distinct")
    nodes = components(near_links(distinct, "fp", radius, tile_rows))
    grouped = distinct.join(nodes, distinct.fp == nodes.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.where("root is not null").groupBy("root").agg(F.min("first").alias("component_id"))
    return fps.join(grouped.join(least, "root").select("fp", "component_id"), "fp").select("doc_id", hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component with all its columns: one whose id is the component's; rows without an id stay.

    Of rows that share id and fingerprint one stays; an id with several fingerprints keeps a row of each, for they may be of
    different components. Other columns may have any names.
    """
    found = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("id"), "fingerprint").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("id"), hex_digits(fingerprint_column()(F.col(text_col))).alias("fingerprint"))
    own = rows.join(found, ["id", "fingerprint"]).dropDuplicates(["id", "fingerprint"]).select("row.*")
    return own.unionByName(docs.where(F.col(id_col).isNull()))
