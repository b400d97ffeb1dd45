"""Lexical and vector search and the prefix trie against brute force, SQL and odd input."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import lexical, pivots, queries, tries
from tests.llm.test_near_and_exact import SF, docs_of
from tests.oracle import compare


@pytest.mark.parametrize("name", ["op11_lexical", "op12_topk", "op13_prefix_trie"])
def test_sql(spark, name):
    compare(spark, queries.queries()[name], queries.oracle_sql()[name], SF)


def slow_ranking(docs, items, top):
    """Every document scored for every item; docs and items: (id, text)."""
    held = [(i, Counter(t), len(t)) for i, t in ((i, lexical.terms_of(x)) for i, x in docs) if t]
    n, length = len(held), sum(x for _, _, x in held)
    df = Counter(t for _, c, _ in held for t in c)
    out = []
    for item, text in items:
        asked, scores = Counter(lexical.terms_of(text)), []
        for doc, c, size in held:
            m = 75 + (25 * size * n) // length
            score = sum(k * math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 12 * m)) for t, k in asked.items() if c[t])
            scores += [(-score, doc is None, doc or 0, doc)] if score > 0 else []
        out += [(item, k + 1, doc, -s) for k, (s, _, _, doc) in enumerate(sorted(scores)[:top])]
    return sorted(out, key=repr)


def test_terms():
    assert lexical.terms_of("AbÉ-x_9\x00Ünï  z") == ["abÉ".encode(), b"x", b"9", "Ünï".encode(), b"z"]
    assert lexical.terms_of(None) == lexical.terms_of(" .,;\n") == []


@pytest.mark.parametrize("block", [4_000_000, 40])
def test_ranking_of_odd_texts(spark, block):
    """Ties, repeats and nulls, all items at once and in small blocks."""
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(12)]
    docs = [(i, " ".join(rng.choice(words, size=rng.integers(1, 9)))) for i in range(60)]
    docs += [(3, docs[3][1]), (100, None), (101, ""), (102, "?!"), (None, "w1 w2 w2"), (None, None), (200, "w1 " * 40_000), (7, "W1 w2"), (8, "w1, w2")]
    items = [(1, "w1 w2 w2 zz"), (2, None), (3, ""), (4, "unknown"), (5, "w3"), (5, "w3"), (None, "w4 w5 W4"), (6, " ".join(words))]
    want = slow_ranking(docs, items, 4)
    frame = docs_of(spark, docs).withColumn("rank", F.lit("clash")).withColumn("item_id", F.lit(0)).withColumn("score", F.lit(1))
    asked = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = lexical.rank(frame, asked, top=4, block_bytes=block)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, got.collect()), key=repr) == want
    assert lexical.rank(frame.limit(0), asked).count() == 0 and lexical.rank(frame, asked.limit(0)).count() == 0


def test_threshold_stops_early_and_loses_nothing(monkeypatch):
    import pyarrow as pa

    rng = np.random.default_rng(2)
    monkeypatch.setattr(lexical, "FIRST_STEP", 1)
    sizes = rng.integers(1, 5, size=3000)
    terms = np.concatenate([np.sort(rng.choice(40, size=s, replace=False)) for s in sizes])
    tfs, n = rng.integers(1, 50, size=len(terms)), rng.integers(5, 400, size=len(sizes))
    ids = pa.array(rng.permutation(len(sizes)))
    shard = lexical.Shard(ids, n, sizes, terms, tfs, (3000, int(n.sum())))
    begin = np.cumsum(sizes) - sizes
    for _ in range(20):
        asked = rng.choice(50, size=3, replace=False)
        factor = rng.integers(0, 4, size=3)
        spread = np.zeros(50, dtype=np.int64)
        docs, scores = shard.best(asked, factor, spread, 10, 0)
        by = dict(zip(asked.tolist(), factor.tolist(), strict=True))
        slow = np.array([sum(int(shard.impact[k]) * by.get(int(terms[k]), 0) for k in range(b, b + s)) for b, s in zip(begin, sizes, strict=True)])
        order = np.lexsort((ids.to_numpy(), -slow))
        order = order[slow[order] > 0][:10]
        assert docs.tolist() == order.tolist() and scores.tolist() == slow[order].tolist() and not spread.any()
        if len(scores) == 10:  # documents below the tenth may be left out, equal ones may not
            kept = shard.best(asked, factor, spread, 10, int(scores[-1]))
            assert kept[0].tolist() == docs.tolist()
            assert len(shard.best(asked, factor, spread, 10, int(scores[0]) + 1)[0]) == 0


def slow_nearest(rows, every, top):
    """rows: (vec_id, vector); every row is scored in whole numbers of any size."""
    held = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(256 * x) for x in v)]
    out = []
    for a, (query, x) in enumerate(held):
        if query is None or query % every:
            continue
        scores = sorted((-max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(x, y, strict=False)))), i is None, i or 0, i) for b, (i, y) in enumerate(held) if a != b)
        out += [(query, k + 1, i, -s) for k, (s, _, _, i) in enumerate(scores[:top])]
    return sorted(out, key=repr)


def test_nearest_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=4).round(1)]) for i in range(150)]
    rows += [(i, [0.5, 0.5, 0.5, 0.5]) for i in range(150, 200)]  # copies: ties
    rows += [(0, [1.0, 0.0, 0.0, 0.0]), (0, [1.0, 0.0, 0.0, 0.0]), (None, [9.0, 9.0, 9.0, 9.0]), (None, [0.1, 0.2, 0.3, 0.4])]
    rows += [(300, None), (301, [1.0, None, 0.0, 0.0]), (302, [math.nan, 0.0, 0.0, 0.0]), (303, [math.inf, 0.0, 0.0, 0.0]), (310, []), (311, [2.0]), (320, [1.0] * 6)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("pivot", F.lit("clash")).withColumn("row", F.lit("clash")).repartition(3)
    for size in (10_000_000, 500):
        got = pivots.nearest(frame, F.col("vec_id") % 10 == 0, pivots=7, block_bytes=size)
        assert got.columns == ["query_id", "rank", "vec_id", "score"]
        assert sorted(map(tuple, got.collect()), key=repr) == slow_nearest(rows, 10, 5)
    assert pivots.nearest(frame.limit(0), F.col("vec_id") % 10 == 0).count() == 0
    assert pivots.nearest(frame.where("vec_id > 299 and vec_id < 304"), F.col("vec_id") % 10 == 0).count() == 0
    large = [(0, [1e200, 1.0]), (1, [1e200, 5.0]), (2, [2.0**40, 2.0**20]), (10, [2.0**40, 1.0]), (11, [3.0, 4.0])]
    got = pivots.nearest(spark.createDataFrame(large, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_nearest(large, 10, 5)


def test_annuli_are_pruned_and_exact(spark):
    """In few dimensions the bounds leave most annuli unread; the answer stays that of all."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 3)) * 6
    rows = [(i, [float(x) for x in centres[i % 12] + rng.normal(size=3) * 0.2]) for i in range(6000)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index, found = pivots.build(frame, "vec_id", "embedding", 256, 12, 2048)
    piece = next(pivots.pieces(iter(index.toArrow().to_batches())))
    x = np.floor(256 * np.array([v for _, v in rows[:40]]))
    q = pivots.Queries(np.full(40, -1), x, (x**2).sum(axis=1), pivots.distances(x, found), np.zeros(40, int), np.zeros(40), np.full(40, -np.inf))
    query, _, score = piece.search(q, 5)
    every = np.sort(pivots.scores_of(x, piece.x), axis=1)[:, ::-1][:, :5]
    assert score.reshape(40, 5).tolist() == every.tolist()
    kth = every[:, -1:]
    assert (piece.bounds(q) >= kth).mean() < 0.6


def slow_trie(rows):
    """Every node by its members; rows: (conv_id, turn, role, text)."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            mark = hashlib.md5(f"{len(role or '')}:{role or ''}{text or ''}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, mark, role or "", text or ""))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    paths = {c: tuple(own.get(c - int(math.fmod(c, 20)), [])[: (h := zlib.crc32(str(c).encode()) % 4)] + ts[h:]) for c, ts in own.items()}
    members, kids = {}, {}
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append(c)
    for node in members:
        if node:
            kids.setdefault(node[:-1], []).append(node)
    out = []

    def total(node):
        below = [total(k) for k in kids.get(node, [])]
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        leaves, saved = sum(b[0] for b in below) or 1, sum(b[1] for b in below) + (len(members[node]) - 1) * words
        ends = ",".join(map(str, sorted(c for c in members[node] if paths[c] == node)))
        out.append((min(members[node]), len(node), min(members[node[:-1]]) if node else None, len(members[node]), len(below), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
        return leaves, saved

    if members:
        total(())
    return sorted(out, key=repr)


def odd_turns():
    rng = np.random.default_rng(5)
    rows = []
    for c in range(-30, 170):
        for turn in range(int(rng.integers(0, 7))):
            rows.append((c, turn, "user" if turn % 2 else None, str(rng.choice(["hi", "how are you", "", "ça va bien\x0bici", "ok \t ok"], p=[0.5, 0.2, 0.1, 0.1, 0.1]))))
    for c in range(1000, 1060):  # copies, many of them
        rows += [(c, k, "user", "same words here") for k in range(5)]
    rows += [(c, k, "user", f"long {k}") for c in (2000, 2001) for k in range(150 + c % 2)]
    rows += [(None, 0, "user", "no id"), (20, None, "user", "first"), (20, None, "user", "first"), (41, 3, None, None), (41, 3, "user", ""), (42, 7, "user", "word " * 50_000), (10**15, 0, "a", "b"), (43, 0, "us", "er:x"), (43, 0, "user", ":x")]
    return rows


@pytest.mark.parametrize("share", [400_000, 400, 40])
def test_trie_of_odd_conversations(spark, share):
    """One task, some tasks and levels, and many of both."""
    rows = odd_turns()
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("depth", F.lit("clash")).withColumn("words", F.lit("clash")).repartition(5)
    got = tries.prefix_trie(tries.rebuilt(frame), task_turns=share, least_turns=share)
    assert got.columns == list(tries.NODE)
    assert sorted(map(tuple, got.collect()), key=repr) == slow_trie(rows)
    if share == 40:
        assert tries.prefix_trie(tries.rebuilt(frame.limit(0))).count() == 0


def test_walk_in_parts_equals_the_whole():
    """Any cut of sorted paths into runs, and any number of levels, gives the nodes of one walk."""
    rng = np.random.default_rng(6)
    marks = [hashlib.md5(bytes([k])).digest() for k in range(3)]
    for _ in range(60):
        paths = sorted((b"".join(marks[k] for k in rng.integers(0, 3, size=rng.integers(0, 6))), i) for i in range(int(rng.integers(1, 40))))
        words = {k: int(m[0]) for k, m in enumerate(marks)}

        def walked(runs, whole, level):
            nodes, kept = [], []
            for run in runs:
                walk = tries.Walk(whole, level > 0)
                for path in run:
                    walk.step(*path)
                walk.finish()
                for values in zip(*walk.rows.values(), strict=True):
                    r = dict(zip(walk.rows, values, strict=True))
                    if r["kind"] == 0:
                        nodes.append((r["conv_id"], r["depth"], r["n_convs"], r["n_children"], r["n_leaves"], r["saved_tokens"]))
                    elif r["kind"] == 1:
                        kept.append((r["key"], r["words"], list(zip(*(r[k] for k in ("at", *tries._SUMS)), strict=True)), None))
            return nodes, kept

        rows = [(k, [words[marks.index(k[a : a + 16])] for a in range(0, len(k), 16)], [(len(k) // 16, 1, i, 0, 0, 0)], i) for k, i in paths]
        want = sorted(walked([rows], True, 0)[0])
        got, level = [], 0
        while True:
            cuts = sorted({0, len(rows), *rng.integers(0, len(rows) + 1, size=len(rows) // 4).tolist()})
            nodes, kept = walked([rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)], len(cuts) == 2, level)
            got += nodes
            if len(cuts) == 2:
                break
            rows, level = sorted(kept, key=lambda r: r[0]), level + 1
        assert sorted(got) == want
