"""The near-dedup stage against brute force at its own parameters: five-word shingles, similarity 0.8."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import simhash, similar, stages
from tests.llm.test_near_and_exact import SF, docs_of


def slow_kept(rows, similarity=0.8):
    split = [re.findall(r"[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) for _, t in rows]
    sets = [Counter([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or [" ".join(w)]) for w in split]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = sum((a & b).values())
            if both >= similarity * (sum(a.values()) + sum(b.values()) - both) - 1e-9:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return {i for i, _ in rows if i is None or i in least.values()}


def test_stage_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    kept = stages.drop_near_copies(spark, docs, SF)
    assert kept.columns == docs.columns
    got = {r.doc_id for r in kept.collect()}
    assert got == slow_kept(rows)
    assert {6, 1} <= got and not {145, 177} & got  # similarity 0.83 at 7 and 11 differing bits


@pytest.mark.parametrize("piece", [1024, 2])
def test_edges_of_similarity(spark, monkeypatch, piece):
    monkeypatch.setattr(similar, "PIECE", piece)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    rows = [(1000, None), (1001, " \t"), (1002, "One two"), (1003, "one  TWO"), (1004, "one two three"), (1005, "la " * 40), (1006, "la " * 50), (1007, "la " * 90)]
    for group in range(12):
        base = [word() for _ in range(rng.randrange(6, 90))]
        for k in range(5):
            text = list(base)
            for _ in range(k):
                at = rng.randrange(len(text))
                text[at : at + rng.randrange(2)] = [word()]
            rows.append((group * 10 + k, " ".join(text)))
    got = {r.doc_id for r in similar.one_of_each(docs_of(spark, rows)).collect()}
    assert got == slow_kept(rows)


def test_ids_that_repeat_or_lack(spark):
    text = "a common text of some words that two rows share"
    kept = similar.one_of_each(docs_of(spark, [(3, text), (1, text), (2, "quite another text with other words in it"), (None, text), (None, None)]))
    assert sorted((r.doc_id or 0, r.text or "") for r in kept.collect()) == [(0, ""), (0, text), (1, text), (2, "quite another text with other words in it")]
    assert similar.one_of_each(docs_of(spark, [])).count() == 0


def test_rows_of_one_id_and_clashing_names(spark):
    text, other = "one text of some words that stands in two rows", "quite another text with other words in it that nobody has"
    rows = docs_of(spark, [(5, text), (5, other), (6, text), (7, other), (7, other), (8, None), (9, " \n"), (4, None)])
    rows = rows.withColumn("key", F.lit("k")).withColumn("root", F.lit(1)).withColumn("row", F.lit(2)).withColumn("rows", F.lit(3))
    got = similar.one_of_each(rows)
    assert got.columns == rows.columns
    assert sorted((r.doc_id, r.text or "") for r in got.collect()) == sorted([(4, ""), (5, text), (5, other)])


def test_tile_pairs_are_all_pairs():
    rng = np.random.default_rng(3)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64) >> np.uint64(40)
    want = {(i, j) for i in range(300) for j in range(i) if (int(prints[i]) ^ int(prints[j])).bit_count() <= 5}
    got = [(max(a, b), min(a, b)) for i, j in simhash.tile_pairs(prints, 5, tile=32) for a, b in zip(i.tolist(), j.tolist(), strict=True)]
    assert len(got) == len(set(got)) and set(got) == want


def test_repeated_shingles_do_not_move_fingerprints(spark):
    """Texts of few shingles that repeat: 0.96 alike, though the bits of their most frequent shingles change sides."""
    a, b = "spam " * 55 + "ham " * 53, "spam " * 53 + "ham " * 55
    assert similar.similarity_of(a, b) > 0.95
    docs = docs_of(spark, [(1, a), (2, b), (3, "spam " * 90 + "ham " * 18)])
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == slow_kept([(1, a), (2, b), (3, "spam " * 90 + "ham " * 18)])


@pytest.mark.parametrize("size", [9, 30, 200])
def test_radius_holds_pairs_at_the_similarity(size):
    """Pairs of similarity 0.8, of distinct and of repeated shingles, lie within the radius."""
    rng = np.random.default_rng(size)
    mask = 2**64 - 1
    for _ in range(400):
        h = rng.integers(0, 2**63, size=size, dtype=np.int64).view(np.uint64) << np.uint64(1)
        k = -(-size * 4 // 5)
        split = k + (size - k) // 2
        pair = h[:split], np.concatenate((h[:k], h[split:]))
        few = np.repeat(h[:3], [size, size // 2, size // 3]), np.repeat(h[:3], [size - size // 8, size // 2, size // 3])
        for x, y in (pair, tuple(map(similar.numbered, few))):
            assert ((similar.print_of(x) ^ similar.print_of(y)) & mask).bit_count() <= similar.RADIUS


def test_large_groups_meet_in_turns(spark, monkeypatch):
    """Pieces, turns and parts of keys change no result; texts that stay are not shuffled, and tables of steps are few at the end."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, rows = [word() for _ in range(60)], []
    for i in range(70):  # alike, but mostly below the similarity: one large group of the second round
        text = list(base)
        for _ in range(rng.randrange(4)):
            text[rng.randrange(60)] = word()
        rows.append((i, " ".join(text)))
    rows += [(100, rows[3][1]), (100, rows[3][1]), (None, rows[3][1])]
    for name, value in (("PIECE_TEXTS", 6), ("CELL_TEXTS", 8), ("TURN_BYTES", 1), ("BROADCAST_ROWS", 9)):
        monkeypatch.setattr(similar, name, value)
    made = []
    monkeypatch.setattr(similar.scratch, "write_and_read", lambda df, name, f=similar.scratch.write_and_read: (made.append(name), f(df, name))[1])
    docs = docs_of(spark, rows)
    assert {r.doc_id for r in similar.one_of_each(docs).collect()} == slow_kept(rows)
    assert made.count("alike") > 3 and made.count("texts") > 3
    monkeypatch.setattr(similar, "BROADCAST_ROWS", 500)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = similar.one_of_each(docs)
        assert "SortMergeJoin" not in out._jdf.queryExecution().executedPlan().toString()
        assert {r.doc_id for r in out.collect()} == slow_kept(rows)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
