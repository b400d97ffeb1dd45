"""SimHash, decontamination, suffix dedup and their stages against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from parley.llm import decontaminate, queries, simhash, stages, suffix

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def slow_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0d]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    parts = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(p, seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints):
    root = {i: i for i, _ in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in prints:
        for j, b in prints:
            if (a ^ b).bit_count() <= 2:
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {i: find(i) for i, _ in prints}


def test_simhash_against_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    want = [(i, slow_fingerprint(t)) for i, t in rows]
    roots = slow_components(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op1_simhash(spark, SF).collect()}
    assert got == {i: (f"{f:016x}", roots[i]) for i, f in want}


def test_simhash_of_odd_texts(spark):
    rows = [(5, None), (2, ""), (9, " \t\n"), (4, "one"), (4, "one"), (7, "One\x0bTWO"), (8, "É é x"), (None, "one"), (None, "alone here it is"), (1, "w " * 70_000)]
    extra = docs_of(spark, rows).withColumn("fp", F.lit("clash")).withColumn("component_id", F.lit(0))
    got = simhash.near_duplicates(extra).collect()
    assert len(got) == len(rows)
    assert {r.component_id for r in got if r.doc_id in (5, 2, 9)} == {2}
    assert all(r.fingerprint == f"{slow_fingerprint(dict(rows)[r.doc_id]):016x}" for r in got if r.doc_id is not None)
    assert simhash.near_duplicates(extra.limit(0)).count() == 0


def test_small_tiles_lose_no_link(spark):
    rng = random.Random(1)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = sorted({b ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for b in base for _ in range(12)})
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    from parley.llm.components import components

    links = simhash.near_links(spark.createDataFrame([(s,) for s in signed], "fp long"), tile_rows=3)
    got = {r.node: r.root for r in components(links).collect()}
    want = slow_components(list(zip(signed, prints, strict=True)))
    assert {s: got.get(s, s) for s in signed} == want


def test_one_of_each_group_stays(spark):
    text = "a common text of some words that two rows share"
    kept = simhash.one_of_each(docs_of(spark, [(3, text), (1, text), (2, "quite another text with other words in it"), (None, text), (None, None)]))
    assert sorted(kept.collect(), key=repr) == sorted(docs_of(spark, [(1, text), (2, "quite another text with other words in it"), (None, text), (None, None)]).collect(), key=repr)


def slow_spans(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    for i, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        edge = np.diff(np.r_[False, gone, False].astype(int))
        out[i] = (len(t), int(gone.sum()), int((edge == 1).sum()), hashlib.sha256(bytes(np.frombuffer(t, dtype=np.uint8)[~gone])).hexdigest())
    return out


def test_suffix_query_against_brute_force(spark):
    rows = [(r.doc_id, (r.text or "").encode()) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op5_suffix(spark, SF).collect()}
    assert got == slow_spans(rows)


@pytest.mark.parametrize("shard_bytes", [300, 1 << 20])
def test_suffix_of_odd_texts(spark, shard_bytes):
    rng = random.Random(2)
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    shared, line = word(120), word(49)
    texts = [(1, shared), (2, word(30) + shared[10:] + word(5)), (3, shared[:60] + word(80) + shared[40:]), (4, None), (5, ""), (6, line), (7, line), (8, "-" * 400), (9, "x" + "-" * 70 + "y"), (10, shared[:50]), (11, shared[1:50]), (12, "ab" * 100), (13, "ba" * 60)]
    texts += [(20 + k, word(40) + shared[k : k + 70] + word(20)) for k in range(30)]
    got = suffix.repeated_spans(docs_of(spark, texts), shard_bytes=shard_bytes).collect()
    want = slow_spans([(i, (t or "").encode()) for i, t in texts])
    assert {r.doc_id: (sum(s.end - s.start for s in r.removed_spans), len(r.removed_spans), hashlib.sha256(bytes(r.kept_bytes)).hexdigest()) for r in got} == {i: w[1:] for i, w in want.items()}
    assert {r.doc_id: r.text for r in got} == dict(texts)


def test_suffix_ids_that_repeat_or_lack(spark):
    text = "this passage is a little longer than fifty bytes, so it counts"
    got = suffix.repeated_spans(docs_of(spark, [(1, text), (1, text), (None, text), (2, text + "!")])).collect()
    assert sorted((r.doc_id or 99, len(r.kept_bytes)) for r in got) == [(1, len(text)), (1, len(text)), (2, 1), (99, 0)]
    assert suffix.repeated_spans(docs_of(spark, [])).count() == 0


def slow_earlier(texts, owners, length=50):
    return [np.array([any(o < owner and t[p : p + length] in u for u, o in zip(texts, owners, strict=True)) for p in range(len(t) - length + 1)]) for t, owner in zip(texts, owners, strict=True)]


@pytest.mark.parametrize("index_bytes", [1 << 20, 700, 64])
def test_groups_are_indexed_in_pieces(index_bytes):
    rng = random.Random(3)
    base = bytes(rng.choice(b"ab") for _ in range(200))
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randrange(50, 90))) for _ in range(30)]
    texts += [base[a : a + rng.randrange(50, 120)] + bytes(rng.choice(b"ab") for _ in range(rng.randrange(9))) for a in range(0, 130, 5)] + texts[:7]
    owners, groups = np.arange(len(texts), dtype=np.int64), np.zeros(len(texts), dtype=np.uint64)
    got = suffix.earlier_windows(groups, texts, owners, index_bytes=index_bytes)
    assert all(np.array_equal(a, b) for a, b in zip(got, slow_earlier(texts, owners), strict=True))


def test_one_group_of_many_pieces():
    rng = random.Random(4)
    shared = [bytes(rng.choice(b"abcdefgh ") for _ in range(60)) for _ in range(300)]
    texts = [rng.choice(shared) + bytes(rng.choice(b"abcdefgh ") for _ in range(10)) for _ in range(12_000)]
    owners = np.arange(len(texts), dtype=np.int64)
    got = suffix.earlier_windows(np.zeros(len(texts), dtype=np.uint64), texts, owners, index_bytes=1 << 17)
    first, want = {}, []
    for o, t in enumerate(texts):
        want.append(np.array([first.setdefault(t[p : p + 50], o) < o for p in range(len(t) - 49)]))
    assert all(np.array_equal(a, b) for a, b in zip(got, want, strict=True))


def test_index_is_small_for_repetitive_texts():
    rng = random.Random(5)
    base = bytes(rng.choice(b"abcdefgh ") for _ in range(4000))
    texts = [base[:k] + b"!" + base[k:] for k in range(1000, 3000, 20)]
    index = suffix.RunIndex(texts, np.arange(len(texts)))
    held = sum(v.size for v in vars(index).values() if isinstance(v, np.ndarray))
    assert held < index.n / 2  # no array has an entry for each byte
    assert np.array_equal(index.owners[np.searchsorted(index.ends, index.sample, side="right")], index.owner(index.sample))


def test_hot_hashes_are_dealt_again(spark, monkeypatch):
    rng = random.Random(6)
    line = "this line is in a great many texts, word for word, and again"
    word = lambda n: "".join(rng.choice("abcé ") for _ in range(n))
    texts = [(k if k % 9 else None, word(rng.randrange(80)) + line + word(rng.randrange(80))) for k in range(1, 120)]
    monkeypatch.setattr(suffix, "HOT_RUNS", 20)
    docs = docs_of(spark, texts)
    hot = suffix.hot_keys(docs, "text", 50)
    shards = [suffix.Shard(np.zeros(119, dtype=np.int64), [t.encode() for _, t in texts], hot=h) for h in (None, hot)]
    assert len(hot) and len(shards[1].keys) > len(shards[0].keys)
    # What the next least hash leaves together goes by whole windows: no group to search is larger than that.
    assert np.unique(shards[0].keys, return_counts=True)[1].max() > 60 and np.unique(shards[1].keys, return_counts=True)[1].max() <= 20
    assert (shards[1].windows == 1).sum() > (shards[0].windows == 1).sum()
    got = suffix.repeated_spans(docs, shard_bytes=2000).collect()
    want = slow_spans([(i if i else 10_000, (t or "").encode()) for i, t in texts if i])
    assert {r.doc_id: len(r.kept_bytes) for r in got if r.doc_id} == {i: w[0] - w[1] for i, w in want.items()}
    named = [t.encode() for i, t in texts if i]
    seen = {t[p : p + 50] for t in named for p in range(len(t) - 49)}
    for r in got:
        if r.doc_id is None:
            raw, gone = r.text.encode(), np.zeros(len(r.text.encode()), dtype=bool)
            for p in range(len(raw) - 49):
                gone[p : p + 50] |= raw[p : p + 50] in seen
            assert len(r.kept_bytes) == int((~gone).sum())


def test_messages_grow_with_runs_not_ranges():
    keys = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 50, dtype=np.uint64) * np.uint64(2))
    part, bounds = suffix.parts_of(keys, 10**9)
    assert len(part) <= 50 and bounds[0] == 0 and bounds[-1] == 50
    part, bounds = suffix.parts_of(keys, 4)
    assert part.tolist() == [0, 1, 2, 3] and all(int(k) >> 62 == p for p, a, b in zip(part, bounds[:-1], bounds[1:], strict=True) for k in keys[a:b])
    assert suffix.parts_of(keys[:0], 4)[1].tolist() == [0]


def test_index_streams_other_texts():
    index = suffix.RunIndex([b"x" * 20 + bytes(range(60, 130)), bytes(range(60, 120)) + b"tail" * 5], np.array([7, 3]))
    found = index.stream([b"zz" + bytes(range(60, 125)) + b"q", b"none of this is anywhere in there, at any place, no"])
    assert found[0][2] == 3 and found[0][12] == 3 and found[0][13] == 7 and found[0][0] == -1
    assert (found[1] == -1).all()


def slow_leaks(docs, items, similarity=0.8):
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    shingles = lambda w: Counter([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or [" ".join(w)])
    out = {}
    for item, text in items:
        want = split(text)
        for doc, words in ((d, split(t)) for d, t in docs):
            if not want or not words:
                continue
            a = shingles(want)
            for p in range(max(1, len(words) - len(want) + 1)):
                b = shingles(words[p : p + len(want)])
                both = sum((a & b).values())
                s = both / (sum(a.values()) + sum(b.values()) - both)
                if s >= similarity:
                    out[doc, item] = max(s, out.get((doc, item), 0))
    return out


def test_decontamination_against_brute_force(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon phi chi psi omega end"
    near = item.replace("alpha", "start").upper()
    rows += [(901, f"before {item} after"), (902, f"x y {near} z"), (903, item[60:]), (904, None), (905, ""), (906, "alpha beta"), (907, "short item"), (908, " ".join(item.split()[1:]))]
    items = [(r.item_id, r.text) for r in bench.collect()] + [(800, item), (801, "short item"), (802, None), (803, "")]
    got = decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string"))
    got = {(r.doc_id, r.item_id): r.similarity for r in got.collect()}
    want = slow_leaks(rows, items)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert {(901, 800), (902, 800), (907, 801)} <= got.keys()


def test_decontamination_of_repeated_shingles(spark):
    """Items of few shingles that repeat, whose counts change sides, are found like others."""
    items = [(1, "spam " * 55 + "ham " * 53), (2, "a b " * 30), (3, "one two three four five six seven")]
    rows = [(1, "x " + "spam " * 53 + "ham " * 55), (2, "b a " * 31), (3, "zero one two three four five six seven eight"), (4, "spam " * 20), (5, "a b " * 9)]
    got = {(r.doc_id, r.item_id): round(r.similarity, 9) for r in decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert got == {k: round(v, 9) for k, v in slow_leaks(rows, items).items()} and set(got) >= {(1, 1), (2, 2), (3, 3)}


def test_decontamination_of_empty_tables_and_its_stage(spark):
    docs, bench = docs_of(spark, [(1, "a leak of five words here"), (None, "a leak of five words here"), (None, "clean"), (2, None)]), spark.createDataFrame([(1, "a leak of five words here")], "item_id long, text string")
    assert decontaminate.leaks(docs.limit(0), bench).count() == 0
    assert decontaminate.leaks(docs, bench.limit(0)).count() == 0
    assert sorted((r.text or "") for r in decontaminate.without_leaks(docs, bench).collect()) == ["", "clean"]


def test_decontamination_runs_no_python(spark):
    plan = queries.op2_decontamination(spark, SF)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|BroadcastNestedLoop", plan)


def test_cut_repeats_keeps_columns_and_whole_characters(spark):
    text = "é" * 10 + "passage that is the same in both of these two documents, é"
    out = stages.cut_repeats(spark, docs_of(spark, [(1, text), (2, "é" + text[3:] + "ü"), (3, None)]), SF)
    assert out.columns == SCHEMA.replace(" long", "").replace(" string", "").split(", ")
    by = {r.doc_id: r for r in out.collect()}
    assert by[1].text == text and by[3].text is None and by[2].n_chars == len(by[2].text) and by[2].text.endswith("ü")


def slow_windows(docs, items, similarity=0.8):
    """(best similarity, first place of it, number of windows) by document and item."""
    split = lambda t: [w for w in re.split(r"[\x20\x09-\x0D]+", (t or "").lower()) if w]
    shingles = lambda w: Counter([" ".join(w[i : i + 5]) for i in range(len(w) - 4)] or [" ".join(w)])
    out = {}
    for item, text in items:
        want = split(text)
        a = shingles(want)
        for doc, words in ((d, split(t)) for d, t in docs if split(t)):
            found = []
            for p in range(max(1, len(words) - len(want) + 1)):
                b = shingles(words[p : p + len(want)])
                both = sum((a & b).values())
                found.append((both / (sum(a.values()) + sum(b.values()) - both), -p))
            found = [f for f in found if f[0] >= similarity]
            if found:
                out[doc, item] = (max(found)[0], -max(found)[1], len(found))
    return out


def leaks_of(spark, rows, items):
    got = decontaminate.leaks(docs_of(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id): (r.similarity, r.first_word, r.n_windows) for r in got}


def test_short_items_inside_long_texts(spark):
    items = [(1, "short item"), (2, "one"), (3, "just three words"), (4, "these are four words"), (5, "now this has five words"), (6, "six words that this one has")]
    rows = [(k, f"a text that goes on for a while and then says {t.upper()} before it goes on and ends") for k, t in items]
    rows += [(20, "short item"), (21, "a short item"), (22, "item short"), (23, "short item short item one"), (24, "one"), (25, None)]
    got = leaks_of(spark, rows, items)
    assert got == slow_windows(rows, items)
    assert {(1, 1), (2, 2), (3, 3), (4, 4)} <= got.keys()


def test_reordered_passages_and_all_windows(spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    filler = lambda n: [word() for _ in range(n)]
    items = [(k, filler(n)) for k, n in enumerate((58, 58, 40, 21, 9, 6))] + [(6, ["la", "li"] * 15), (7, ["la"] * 30)]
    rows = []
    for k, words in items:
        half = len(words) // 2
        for j, text in enumerate((words[half:] + words[:half], words, words[1:], words[: half - 1] + [word()] + words[half:], words * 2, words[3:] + words[:3])):
            rows.append((k * 10 + j, " ".join(filler(30) + text + filler(30))))
            rows.append((1000 + k * 10 + j, " ".join(text)))
    items = [(k, " ".join(words)) for k, words in items]
    got, want = leaks_of(spark, rows, items), slow_windows(rows, items)
    assert got == want
    assert (0, 0) in got and round(got[0, 0][0], 3) == 0.862
