"""Prefix trie of conversations by Patricia construction.

A conversation is a path of turns. Paths are sorted and dealt to tasks by ranges. A task walks its run of paths once with
a stack that holds points only: where paths branch, where a conversation ends, and leaves; the edge between two points
stands for all turns between them. When the walk leaves a point, its totals are final; its edge is then expanded to the
nodes on it by suffix sums, and the totals go to the point above. Nodes on a task's first and last path may go on in
the neighbours' runs: these two paths with what hangs on them are the rows of the next level, which does the same, until
one task holds what is left (two paths of each task before, at most half of the rows).

Turns are told apart by 128 bits of hash. Turns with a null conversation take no part; a null role or text is empty; null
turn numbers come first, and turns of equal number are in the order of their hash, repeated rows included. Conversations
without turns end at the root. An empty table has no node. Only the named columns are read. A conversation's hashes and
word counts, 24 bytes a turn, are one row; the members that end at one node are never gathered: tasks join the ids of their
run, and these pieces stream through the digest in order.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parley.llm import scratch

#: A task's share of turns, more or less, and the least share that is worth a task of its own.
TASK_TURNS, LEAST_TURNS = 400_000, 5_000
#: So many nodes on tasks' first and last paths are sent to all executors; beyond, a join shuffles.
BROADCAST_NODES = 200_000
CYCLE, LEADS, _LEAD = 20, 4, 3
UNIT = 16
NODE = {"conv_id": pa.int64(), "depth": pa.int64(), "parent_conv_id": pa.int64(), "n_convs": pa.int64(), "n_children": pa.int64(), "n_leaves": pa.int64(), "saved_tokens": pa.int64(), "ends_sha256": pa.string()}
_SUMS = ("mass", "low", "kids", "leaves", "saved")
_OUT = pa.schema(list({"kind": pa.int8(), **NODE, "node_key": pa.binary(), "parent_key": pa.binary(), "first_id": pa.int64(), "ids": pa.string(), "key": pa.binary(), "words": pa.list_(pa.int64()), "at": pa.list_(pa.int64()), **{k: pa.list_(pa.int64()) for k in _SUMS}}.items()))
_SQL = {pa.int8(): "tinyint", pa.int64(): "long", pa.string(): "string", pa.binary(): "binary", pa.list_(pa.int64()): "array<long>"}
_DDL = ", ".join(f"{f.name} {_SQL[f.type]}" for f in _OUT)
_KIND_NODE, _KIND_PATH, _KIND_ENDS = range(3)
_NO_END = hashlib.sha256(b"").hexdigest()


def conversations(turns: DataFrame, *by: str, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, *by, turns): every conversation's turns in order, each its place, hash and words; by: expressions on conv_id."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role_col, text_col))
    words = F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    rows = turns.where(F.col(conv_col).isNotNull()).select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"), words.cast("long").alias("words")).alias("t"))
    rows = rows.select("conv_id", *(F.expr(e).alias(f"by{i}") for i, e in enumerate(by)), "t")
    names = [f"by{i}" for i in range(len(by))]
    dealt = rows.repartition(*names) if names else rows
    return dealt.groupBy(*names, "conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))


def rebuilt(turns: DataFrame, cycle: int = CYCLE, leads: int = LEADS) -> DataFrame:
    """(conv_id, turns): the first turns are those of the conversation at the last multiple of `cycle`, as many as the id's CRC says."""
    own = conversations(turns, f"conv_id - conv_id % {cycle}")
    lead = F.max(F.when(F.col("conv_id") == F.col("by0"), F.slice("turns", 1, leads - 1))).over(Window.partitionBy("by0"))
    taken = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(leads)).cast("int")
    none = F.slice("turns", 1, 0)
    out = own.select("conv_id", "turns", lead.alias("lead"), taken.alias("h"))
    return out.select("conv_id", F.concat(F.coalesce(F.slice("lead", F.lit(1), F.col("h")), none), F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


class Point:
    """A branch, an end or a leaf: members, the least of them, children, leaves and saved tokens below, and who ends here."""

    __slots__ = ("depth", "mass", "low", "kids", "leaves", "saved", "ids", "waiting")

    def __init__(self, depth: int):
        self.depth, self.mass, self.low, self.kids, self.leaves, self.saved = depth, 0, None, 0, 0, 0
        self.ids: list[int] = []
        self.waiting: list[int] = []  # nodes whose parent this is

    def add(self, mass: int, low: int | None, kids: int, leaves: int, saved: int) -> None:
        self.mass, self.kids, self.leaves, self.saved = self.mass + mass, self.kids + kids, self.leaves + leaves, self.saved + saved
        if low is not None and (self.low is None or low < self.low):
            self.low = low


def common(a: bytes, b: bytes) -> int:
    """How many turns two keys begin with alike."""
    n = min(len(a), len(b))
    other = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return (n - (other.bit_length() + 7) // 8) // UNIT


def key_digests(key: bytes) -> list[bytes]:
    """A digest for every beginning of a key, the empty one first."""
    running, out = hashlib.md5(), []
    for at in range(0, len(key) + UNIT, UNIT):
        out.append(running.digest())
        running.update(key[at : at + UNIT])
    return out


class Walk:
    """One pass over sorted paths; `rows` gathers nodes, and where other tasks may hold more of them, paths and ends."""

    def __init__(self, whole: bool, named: bool):
        self.whole, self.named = whole, named  # nothing beyond these paths; nodes carry keys
        self.rows: dict[str, list] = {f.name: [] for f in _OUT}
        self.stack, self.left = [Point(0)], []
        self.first: tuple[bytes, list[int]] | None = None
        self.path: tuple[bytes, list[int]] | None = None
        self.names: tuple[bytes, list[bytes]] | None = None
        self.open = -1  # down to this depth the current path is the first one

    def row(self, **values) -> int:
        for name, column in self.rows.items():
            column.append(values.get(name))
        return len(self.rows["kind"]) - 1

    def name(self, key: bytes, depth: int) -> bytes:
        if self.names is None or self.names[0] is not key:
            self.names = (key, key_digests(key))
        return self.names[1][depth]

    def step(self, key: bytes, words: list[int], hanging: Iterable[tuple], conv_id: int | None) -> None:
        """The next path; hanging: (depth, members, least, children, leaves, saved) that it carries."""
        if self.path is None:
            self.first, self.open = (key, words), -1 if self.whole else len(words)
        else:
            self.leave(common(self.path[0], key))
        self.path = (key, words)
        for depth, *sums in hanging:
            self.at(depth).add(*sums)
        end = self.at(len(words))
        if conv_id is not None:
            end.ids.append(conv_id)

    def at(self, depth: int) -> Point:
        if self.stack[-1].depth < depth:
            self.stack.append(Point(depth))
            return self.stack[-1]
        place = bisect_left(self.stack, depth, key=lambda p: p.depth)
        if self.stack[place].depth != depth:
            self.stack.insert(place, Point(depth))
        return self.stack[place]

    def leave(self, depth: int) -> None:
        """The walk goes back to this depth: points below are final, but those of the first path, which stay open."""
        floor = max(depth, self.open)
        while self.stack[-1].depth > floor:
            point = self.stack.pop()
            self.close(point, self.at(max(self.stack[-1].depth, floor)))
        if depth < self.open:
            while self.stack[-1].depth > depth:
                self.left.append(self.stack.pop())
            self.open = depth

    def close(self, point: Point, above: Point) -> None:
        """The nodes from a point up to, and without, the point above."""
        key, words = self.path
        leaves, saved, low = point.leaves if point.kids else 1, point.saved, point.low
        ends = hashlib.sha256(",".join(map(str, point.ids)).encode()).hexdigest() if point.ids else _NO_END
        for place in point.waiting:
            self.rows["parent_conv_id"][place] = low
        for depth in range(point.depth, above.depth, -1):
            saved += (point.mass - 1) * words[depth - 1]
            here = depth == point.depth
            place = self.row(kind=_KIND_NODE, conv_id=low, depth=depth, parent_conv_id=low, n_convs=point.mass, n_children=point.kids if here else 1, n_leaves=leaves, saved_tokens=saved, ends_sha256=ends if here else _NO_END, node_key=self.name(key, depth) if self.named else None)
        self.rows["parent_conv_id"][place] = None
        above.waiting.append(place)
        above.add(point.mass, low, 1, leaves, saved)

    def finish(self) -> None:
        if self.path is None:
            return
        if self.whole:
            self.leave(0)
            root = self.stack[0]
            for place in root.waiting:
                self.rows["parent_conv_id"][place] = root.low
            ends = hashlib.sha256(",".join(map(str, root.ids)).encode()).hexdigest()
            self.row(kind=_KIND_NODE, conv_id=root.low, depth=0, n_convs=root.mass, n_children=root.kids, n_leaves=root.leaves if root.kids else 1, saved_tokens=root.saved, ends_sha256=ends, node_key=self.name(self.path[0], 0) if self.named else None)
            return
        for path, points in ((self.first, self.left[::-1]), (self.path, self.stack)):
            if points:
                self.keep(*path, points)

    def keep(self, key: bytes, words: list[int], points: list[Point]) -> None:
        """A path with what hangs on it goes to the next level."""
        for point in points:
            for place in point.waiting:
                self.rows["parent_key"][place] = self.name(key, point.depth)
            if point.ids:
                self.row(kind=_KIND_ENDS, node_key=self.name(key, point.depth), first_id=point.ids[0], ids=",".join(map(str, point.ids)))
        self.row(kind=_KIND_PATH, key=key, words=words, at=[p.depth for p in points], **{k: [getattr(p, k) for p in points] for k in _SUMS})


def walked(paths: DataFrame, whole: bool, level: int) -> DataFrame:
    """Nodes, paths and ends of each task's run. Paths of level 0 are conversations, later ones carry sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        walk = Walk(whole, named=level > 0)
        for rows in batches:
            keys, words = rows.column("key").to_pylist(), rows.column("words").to_pylist()
            if level:
                sums = zip(*(rows.column(k).to_pylist() for k in ("at", *_SUMS)), strict=True)
                for key, path, columns in zip(keys, words, sums, strict=True):
                    walk.step(key, path, zip(*columns, strict=True), None)
            else:
                for key, path, conv_id in zip(keys, words, rows.column("conv_id").to_pylist(), strict=True):
                    walk.step(key, path, ((len(path), 1, conv_id, 0, 0, 0),), conv_id)
        walk.finish()
        for at in range(0, len(walk.rows["kind"]), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(walk.rows[f.name][at : at + 50_000], f.type) for f in _OUT], schema=_OUT)
        scratch.tidy()

    return paths.mapInArrow(run, _DDL)


def digests(ends: DataFrame) -> DataFrame:
    """(node_key, ends_sha256) of ids that come in pieces: these stream through the digest in order, none is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, running = None, None
        for rows in batches:
            keys, found = [], []
            for key, ids in zip(rows.column("node_key").to_pylist(), rows.column("ids"), strict=True):
                if key != current:
                    if current is not None:
                        keys.append(current)
                        found.append(running.hexdigest())
                    current, running = key, hashlib.sha256()
                else:
                    running.update(b",")
                running.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(found, pa.string())], ["node_key", "ends_sha256"])
        if current is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], pa.binary()), pa.array([running.hexdigest()])], ["node_key", "ends_sha256"])

    return ends.select("node_key", "first_id", "ids").repartition("node_key").sortWithinPartitions("node_key", "first_id").mapInArrow(run, "node_key binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame, task_turns: int = TASK_TURNS, least_turns: int = LEAST_TURNS) -> DataFrame:
    """A row for every node (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256); sequences: (conv_id, turns) as `conversations` gives them."""
    spark = sequences.sparkSession
    key = F.unhex(F.array_join(F.transform("turns", lambda t: t["mark"]), ""))
    paths = scratch.write_and_read(sequences.select("conv_id", key.alias("key"), F.transform("turns", lambda t: t["words"]).alias("words")), "paths")
    nodes, ends, level = [], None, 0
    while True:
        rows, turns = paths.agg(F.count("*"), F.coalesce(F.sum(F.size("words")), F.lit(0))).first()
        tasks = min(max(-(-turns // task_turns), min(spark.sparkContext.defaultParallelism, turns // least_turns)), rows // 4)
        order = ["key"] if level else ["key", "conv_id"]
        dealt = paths.repartitionByRange(tasks, *order) if tasks > 1 else paths.coalesce(1)
        out = scratch.write_and_read(walked(dealt.sortWithinPartitions(*order), tasks <= 1, level), "trie")
        scratch.discard(paths)
        nodes.append(out.where(F.col("kind") == _KIND_NODE).select(*NODE, "node_key", "parent_key"))
        if tasks <= 1:
            break
        ends = out.where(F.col("kind") == _KIND_ENDS) if ends is None else ends
        paths = scratch.write_and_read(out.where(F.col("kind") == _KIND_PATH).select("key", "words", "at", *_SUMS), "paths")
        level += 1
    if not level:
        return nodes[0].select(*NODE)
    shared = reduce(DataFrame.unionByName, nodes[1:])  # nodes of the first and last paths of tasks
    found = digests(ends).withColumnRenamed("ends_sha256", "found")
    shared = scratch.write_and_read(shared.join(found, "node_key", "left").withColumn("ends_sha256", F.coalesce("found", "ends_sha256")).select(*NODE, "node_key", "parent_key"), "shared-nodes")
    parents = shared.select(F.col("node_key").alias("parent_key"), F.col("conv_id").alias("above"))
    parents = F.broadcast(parents) if parents.count() <= BROADCAST_NODES else parents
    every = nodes[0].unionByName(shared)
    below = every.where("parent_key is not null").join(parents, "parent_key").withColumn("parent_conv_id", F.col("above"))
    return every.where("parent_key is null").select(*NODE).unionByName(below.select(*NODE))
