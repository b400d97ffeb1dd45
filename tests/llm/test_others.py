"""The remaining operators: brute force, round trips, held-out accuracy, and odd input."""

import base64
import gzip
import hashlib
import io
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.llm import decontaminate, langid, licenses, packing, quality, queries, scratch, simhash, suffix, tokencounts, tokens, toxicity, warc
from tests.llm.test_near_and_exact import SF, docs_of
from tests.oracle import compare

ODD = [(1, None), (2, ""), (3, " \t"), (4, "one two"), (4, "one two"), (None, "no id"), (6, "word " * 30_000), (7, "123 !!"), (8, "x\ny\nx\n\nx"), (9, "<|endoftext|> déjà")]


def held(doc_id, folds):
    return zlib.crc32(str(doc_id).encode()) % folds


def slow_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, dup, seen = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)], 0, set()
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered |= {i, i + 1, i + 2}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


def test_quality_counts_and_verdicts(spark):
    rows = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = {r.doc_id: r for r in queries.op4_quality(spark, SF).collect()}
    for r in rows:
        q, want = got[r.doc_id], slow_quality(r.text)
        assert (q.n_words, q.word_chars, q.n_symbols, q.n_dup_lines, q.n_repeat_words) == want
        assert q.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (q.base_failed and q.kept)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    judged = [(labels[i], q.kept) for i, q in got.items() if i in labels and not q.base_failed]
    assert sum(bool(y) == k for y, k in judged) >= 0.95 * len(judged)


def test_quality_of_odd_texts(spark):
    got = quality.judge(docs_of(spark, ODD)).collect()
    assert len(got) == len(ODD) and not any(r.kept for r in got)
    assert all((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == slow_quality(dict(ODD)[r.doc_id]) for r in got)
    assert quality.judge(docs_of(spark, [])).count() == 0


def test_expectation_maximisation_finds_accuracies():
    rng = np.random.default_rng(0)
    good = rng.random(20_000) < 0.8
    accuracy = [0.95, 0.9, 0.85, 0.8]
    votes = np.stack([np.where(rng.random(len(good)) < a, good, ~good) * 2 for a in accuracy], axis=1)
    codes, counts = np.unique((votes * 3 ** np.arange(4)).sum(axis=1), return_counts=True)
    model = quality.fit(codes, counts, rules=4)
    assert abs(model.good - 0.8) < 0.05
    assert all(abs(model.rates[k, 1, 2] - a) < 0.05 and abs(model.rates[k, 0, 0] - a) < 0.08 for k, a in enumerate(accuracy))


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/é b\r\n", "<p>same</p>"), (2, "u", "<p>same</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 70_000), (None, "u", "<p>same</p>"), (6, "u", "only"), (7, "u", "x"), (7, "v", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit(1)).repartition(3)
    for split, least in ((64, 0), (1 << 20, 5)):
        got = warc.round_trip(pages, min_revisit_bytes=least, split_bytes=split).collect()
        assert len(got) == len(rows)
        for r in got:
            raw = (next(h for i, _, h in rows if i == r.page_id) or "").encode()
            assert (r.payload_bytes, r.payload_digest) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        kinds = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got)
        none = ("response", None)
        assert kinds == [(0, *none), (1, "revisit", 2), (2, *none), (3, *(("revisit", 4) if not least else none)), (4, *none), (5, *none), (6, *none), (7, *none), (7, *none)]
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_warc_scan_skips_false_magic_and_reports_damage():
    class File(io.BytesIO):
        def read_at(self, n, at):
            self.seek(at)
            return self.read(n)

    a, b = (warc.page_record(i, "u", "text " * i, None) for i in (3, 400))
    raw = b"\x1f\x8b\x08junk" + gzip.compress(b"no record") + a + b"\x1f\x8b" + b
    found = [x for s in range(0, len(raw), 50) for x in warc.records(File(raw), len(raw), s, min(s + 50, len(raw)))]
    assert [h["WARC-Record-ID"] for _, h, _ in found] == ["<urn:x-page:3>", "<urn:x-page:400>"]
    with pytest.raises(OSError):
        list(warc.records(File(raw[:-20]), len(raw) - 20, 0, len(raw)))


def library():
    """The vocabulary's own tokenizer, which no code of the package has touched."""
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def check_packing(rows, texts):
    encode = library()
    ids = [encode.encode(t or "", add_special_tokens=False).ids + [1] for _, t in texts]
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for (i, _), own in zip(texts, ids, strict=True):
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        at = 0
        for p in pieces:
            assert p.start == at and p.doc_tokens == len(own)
            assert p.ids_crc32 == zlib.crc32(np.array(own[at : at + p.length], dtype="<u4").tobytes())
            at += p.length
        assert at == len(own)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda r: r.offset):
            assert p.offset == at
            at += p.length
        assert at <= 2048 and (at == 2048 or at & (at - 1) == 0)


def test_packing_is_a_partition(spark):
    texts = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    check_packing(queries.op7_packing(spark, SF).collect(), texts)
    odd = [(i, t) for i, t in dict(ODD).items()] + [(70, " " * 5000 + "x"), (71, "a" * 9000)]
    check_packing(packing.pack(docs_of(spark, odd).repartition(2)).collect(), odd)
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_least_squares_and_combinations():
    plans = packing.combinations(8, 3)
    assert (plans.T @ np.arange(1, 8) == 8).all() and plans.shape[1] == len({tuple(p) for p in plans.T})
    counts = plans @ np.arange(plans.shape[1])
    x = packing.non_negative_least_squares(plans, counts)
    assert (x >= 0).all() and np.allclose(plans @ x, counts)
    assert (packing.non_negative_least_squares(np.array([[1.0, -1.0]]), np.array([-2.0])) == [0, 2]).all()


def test_token_ids_are_the_library_s():
    e = tokens.encoder()
    exact = library()
    assert e.ids("a <|endoftext|> b").tolist() == [64, 220, 50256, 275]
    for t in ["", "a <|endoftext|> b", "<|endoftext|>", "x<|endoftext|><|endoftext|>\n", "Ünï 東京 🙂\n\n\t x", "  lots   of space \n ", "it's we'll 12'3", "a" * 6000, " " * 3000 + "b"]:
        assert e.ids(t).tolist() == exact.encode(t, add_special_tokens=False).ids


def test_toxicity_held_out(spark):
    rows = queries.op8_toxicity(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.toxic for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (held(r.doc_id, 5) == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    out = [(r.predicted, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in out) >= 0.9 * len(out)


def test_toxicity_of_odd_texts(spark):
    docs = docs_of(spark, [*ODD, (20, "you idiot"), (21, "a calm text")])
    labels = spark.createDataFrame([(20, 1), (21, 0), (None, 1), (6, None)], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, labels)).count() == len(ODD) + 2
    alike = toxicity.fit(["a", "b"], np.array([0, 0]))
    assert toxicity.score(docs, alike).where("predicted = 1").count() == 0
    assert toxicity.score(docs.limit(0), alike).count() == 0


def test_language_held_out(spark):
    rows = queries.op10_langid(spark, SF).collect()
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    out = [r for r in rows if r.held_out]
    assert all(r.held_out == (held(r.doc_id, 4) == 2) for r in rows)
    assert sum(r.lang_pred == truth[r.doc_id] for r in out) >= 0.95 * len(out)


def test_language_of_odd_texts(spark):
    model = langid.fit(["the quick brown fox", "der schnelle braune Fuchs"], ["en", "de"])
    got = {r.doc_id: r for r in langid.identify(docs_of(spark, ODD), model).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 7)] == ["und"] * 4 and got[1].score == 0 and not got[None].held_out
    assert langid.identify(docs_of(spark, []), model).count() == 0
    assert langid.fit([], []).predict(["a"])[0] == ["und"]


def test_kernel_is_the_matrix_product():
    texts, langs = ["ab cd ef", "xy zz yx", "ab ef gh", "zz yx xy q"], ["a", "b", "a", "b"]
    model = langid.fit(texts, langs)
    assert model.predict(texts)[0] == langs


def test_token_rollup(spark):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, deleted boolean").withColumn("tokenizer", F.lit("clash"))
    roll = tokencounts.Rollup(spark, scratch.fresh(spark, "test"), {"words-v1": tokencounts.word_count})
    total = lambda: sorted(((r.source, r.lang, r.n_docs, r.n_tokens, r.n_bytes) for r in roll.totals().collect()), key=repr)
    assert total() == []
    assert roll.apply("a", make([(1, "s", "en", "a b c", None), (2, "s", "en", "x", False), (2, "s", "en", "x", False), (None, None, None, None, None)]))
    assert total() == [("s", "en", 2, 4, 6), (None, None, 1, 0, 0)]
    assert not roll.apply("a", make([(3, "s", "en", "late", False)]))
    assert roll.apply("b", make([(1, "t", "fr", "a b", False), (2, "s", "en", None, True), (9, "s", "en", None, True)]))
    assert total() == [("t", "fr", 1, 2, 3), (None, None, 1, 0, 0)]
    assert roll.apply("c", make([])) and roll.apply("d", make([(1, "t", "fr", "a b c d", False)]))
    assert total() == [("t", "fr", 1, 4, 7), (None, None, 1, 0, 0)]


def test_token_query_against_brute_force(spark):
    encode = library()
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        want[r.source, r.lang, "byte_bpe_50k-v1"] += len(encode.encode(r.text or "", add_special_tokens=False).ids)
        want[r.source, r.lang, "words-v1"] += len((r.text or "").encode().split())
    assert {(r.source, r.lang, r.tokenizer): r.n_tokens for r in queries.op3_token_counts(spark, SF).collect()} == want


def test_license_scan(spark):
    words = licenses.TEMPLATES["MIT"].split()
    words[5] = "foo"
    del words[30]
    words.insert(50, "bar")
    rows = [(1, "xx " + " ".join(words) + " yy"), (2, "Text.\nReleased under the MIT License.\nMore. Released under the MIT license!"), (3, "released under the terms"), (4, None), (5, ""), (None, "licensed under cc by-nc 4.0")]
    got = licenses.scan(docs_of(spark, rows)).collect()
    assert sorted((r.doc_id or 0, r.license_id) for r in got) == [(0, "CC-BY-NC-4.0-notice"), (1, "MIT"), (2, "MIT-notice"), (2, "MIT-notice")]
    mit = next(r for r in got if r.license_id == "MIT")
    assert 0.95 < mit.coverage < 1 and rows[0][1][mit.start_char : mit.end_char].startswith("Permission") and mit.end_char == len(rows[0][1]) - 4
    assert licenses.scan(docs_of(spark, [])).count() == 0


def test_license_places_repeats_and_siblings(spark):
    index = licenses.Templates(licenses.TEMPLATES)
    text = "İİİİ Released under the MIT License"
    assert [(m[0], text[m[3] : m[4]]) for m in index.scan(text)] == [("MIT-notice", text[5:])]
    for n in (1, 2, 7, 300):
        found = index.scan("Released under the MIT License. " * n)
        assert [(m[0], m[3]) for m in found] == [("MIT-notice", 32 * k) for k in range(n)]
    for name, whole in licenses.TEMPLATES.items():
        assert [m[:2] for m in index.scan(f"aa {whole} bb")] == [(name, 1.0)]
    for notice, name in (("Licensed under CC BY-SA 4.0", "CC-BY-SA-4.0-notice"), ("Released under the BSD License", "BSD-notice")):
        assert [m[0] for m in index.scan(notice)] == [name]


def slow_coverage(template, words):
    """Words that match in the best local alignment: two for a match, less one for a word changed, added or left out."""
    best, above = (0, 0), [(0, 0)] * (len(words) + 1)
    for t in template:
        row = [(0, 0)]
        for j, w in enumerate(words):
            options = [(above[j][0] + (2 if t == w else -1), above[j][1] + (t == w)), (above[j + 1][0] - 1, above[j + 1][1]), (row[j][0] - 1, row[j][1])]
            row.append(max([o for o in options if o[0] > 0], default=(0, 0)))
        above, best = row, max(best, max(row))
    return best[1]


def test_license_coverage_against_brute_force():
    rng = np.random.default_rng(8)
    template = [f"w{k}" for k in range(40)]
    index = licenses.Templates({"t": " ".join(template)})
    for _ in range(60):
        words = list(template)
        for _ in range(rng.integers(0, 9)):
            at = int(rng.integers(0, len(words)))
            words[at : at + int(rng.integers(0, 2))] = ["zz"] * int(rng.integers(0, 2))
        words = ["aa"] * int(rng.integers(0, 30)) + words + ["bb"] * 5
        want = slow_coverage(template, words)
        assert [m[2] for m in index.scan(" ".join(words))] == ([want] if want >= 32 else [])


def slow_license_lines(text):
    return sum(len(re.findall(re.escape(t), text or "")) for t in ("Released under the MIT License", "Licensed under CC BY-NC 4.0", "Licensed under the Apache License, Version 2.0", "This work is licensed under the GNU General Public License, version 3"))


def test_license_query_finds_planted_lines(spark):
    got = Counter(r.doc_id for r in queries.op9_licenses(spark, "/root/testdata/sf0.01").collect())
    want = {r.doc_id: n for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect() if (n := slow_license_lines(r.text))}
    assert got == want


LARGE = [(2**53 + 1, "the same words in two rows, and a few more of them"), (None, "no id"), (2**53 + 3, "the same words in two rows, and a few more of them"), (2**62 + 1, None)]


def test_large_ids_beside_null_ones(spark):
    docs = docs_of(spark, LARGE).coalesce(1)
    model = langid.fit(["the quick brown fox", "der schnelle braune Fuchs"], ["en", "de"])
    want = sorted([i for i, _ in LARGE], key=str)
    alike = toxicity.fit(["a", "b"], np.array([0, 0]))
    for out in (quality.judge(docs), langid.identify(docs, model), toxicity.score(docs, alike), simhash.near_duplicates(docs), suffix.repeated_spans(docs)):
        assert sorted([r.doc_id for r in out.collect()], key=str) == want
    notice = docs.withColumn("text", F.lit("Released under the MIT License"))
    assert sorted([r.doc_id for r in licenses.scan(notice).collect()], key=str) == want
    pages = docs.select(F.col("doc_id").alias("page_id"), F.lit("u").alias("url"), F.col("text").alias("html"))
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.round_trip(pages).collect()}
    assert got == {2**53 + 1: ("revisit", 2**53 + 3), None: ("response", None), 2**53 + 3: ("response", None), 2**62 + 1: ("response", None)}


def test_clashing_columns(spark):
    names = "key row id rows words window length fp hashes shingles signal votes license_id lang_pred score digest start at __id __to __raw __kept __leak component_id fingerprint".split()
    docs = docs_of(spark, [(1, "one text that is here and also there, in fifty bytes and more of them"), (2, "and one text that is here and also there, in fifty bytes and more of them"), (None, None)])
    docs = docs.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))
    items = spark.createDataFrame([(1, "one text that is here and also")], "item_id long, text string").withColumn("words", F.lit(1))
    model = langid.fit(["the quick brown fox", "der schnelle braune Fuchs"], ["en", "de"])
    for out in (simhash.near_duplicates(docs), quality.judge(docs), langid.identify(docs, model), toxicity.score(docs, toxicity.fit(["a", "b"], np.array([0, 0])))):
        assert out.count() == 3
    assert packing.pack(docs).select("doc_id").distinct().count() == 3
    assert decontaminate.leaks(docs, items).count() == 2 and licenses.scan(docs).count() == 0
    left = decontaminate.without_leaks(docs, items)
    assert left.columns == docs.columns and left.count() == 1
    cut = suffix.without_repeats(docs)
    assert cut.columns == docs.columns and sorted((r.doc_id or 0, len(r.text or "")) for r in cut.collect()) == [(0, 0), (1, 69), (2, 4)]
    assert simhash.one_of_each(docs).columns == docs.columns


def test_language_fit_leaves_no_language_out(spark):
    rows = [(k * 1000 + j, f"{'abcdefghijklmnopqrstuvwxyz'[k % 26] * 3}{k} word {j}", f"l{k:03d}", "s", 1) for k in range(230) for j in range(3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    learned = {r.lang for r in docs.collect() if held(r.doc_id, 4) != 2}
    assert set(langid.train(docs, per_lang=2).langs) == learned and len(learned) > 200
    assert set(langid.train(docs, max_rows=10).langs) == learned


def test_language_fit_on_few_or_equal_texts(spark):
    assert langid.fit(["hello world"], ["en"]).predict(["hello", "bonjour", "1"])[0] == ["en", "en", "und"]
    langs, scores = langid.fit(["same text"] * 4, ["de", "de", "en", "en"]).predict(["same text"])
    assert langs == ["de"] and scores[0] == pytest.approx(0.5)
    assert langid.fit(["eins zwei", "one two"], ["de", "en"]).predict(["zwei", "two"])[0] == ["de", "en"]
    # Hardly a text of xx has a letter: the few that do are found among all.
    rows = [(i, "xylo xx yy" if i == 777 else "12 34 !", "xx") for i in range(1500)] + [(5000 + i, f"wort und satz {i}", "de") for i in range(40)] + [(6000 + i, f"word and phrase {i}", "en") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert held(777, 4) != 2
    model = langid.train(docs)
    assert model.langs == ["de", "en", "xx"] and model.predict(["xylo xx yy"])[0] == ["xx"]


def test_language_kernel_against_brute_force():
    """With every text a landmark, Nyström features give the exact kernel: scores equal ridge regression on it."""
    texts, langs = ["ab cd ef", "xy zz yx", "ab ef gh", "zz yx xy q", "cd ab"], ["a", "b", "a", "b", "a"]
    sets = [{bytes(raw[i : i + n]) for n in langid.ORDERS for i in range(len(raw) - n + 1)} for raw in (f" {t} ".encode() for t in texts)]
    kernel = np.array([[len(x & y) / (len(x) * len(y)) ** 0.5 for y in sets] for x in sets])
    rows = langid.presence(texts, np.zeros((len(texts), 1 << langid.BITS), dtype=np.float32))
    scaled = rows / np.sqrt(rows.sum(axis=1))[:, None]
    assert np.allclose(scaled @ scaled.T, kernel, atol=1e-6)  # no two n-grams share a slot here
    model = langid.fit(texts, langs, per_lang=9)
    weight = np.array([1 / 3 if x == "a" else 1 / 2 for x in langs]) / 2
    y = np.where(np.array(langs)[:, None] == np.array(["a", "b"]), 1.0, -1.0)
    values, vectors = np.linalg.eigh(kernel)
    features = vectors * np.sqrt(values)
    x, target = features - weight @ features, y - weight @ y
    coef = np.linalg.solve(x.T @ (weight[:, None] * x) + 1e-2 * np.eye(5) * (weight @ (x**2)).mean(), x.T @ (weight[:, None] * target))
    want = x @ coef + weight @ y
    got = scaled @ model.weights + model.bias
    assert np.allclose(got, want, atol=1e-3)


def slow_score(model, text):
    raw = f" {' '.join((text or '').lower().split())} ".encode()
    slots = set()
    for n in toxicity.ORDERS:
        for i in range(len(raw) - n + 1):
            h = raw[i]
            for c in raw[i + 1 : i + n]:
                h = (h * 0x01000193 + c) & 0xFFFFFFFF
            h = ((h * 0x9E3779B1 & 0xFFFFFFFF) ^ (n * 0x85EBCA6B & 0xFFFFFFFF)) * 0xC2B2AE35 & 0xFFFFFFFF
            slots.add(int(model.slots[h >> (32 - toxicity.BITS)]))
    return 1 / (1 + np.exp(-(model.bias + sum(model.weights[s] for s in slots if s >= 0))))


def test_toxicity_scores_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert got.keys() == texts.keys() and all(abs(got[i] - slow_score(model, texts[i])) < 1e-9 for i in texts)
    for t in (None, "", "x", "a long text " * 50):
        assert toxicity.unpacked(toxicity.packed(t)).tolist() == sorted(set(toxicity.gram_hashes(t or "").tolist()))


def test_quality_posterior_against_brute_force(spark):
    rows = [r for r in queries.op4_quality(spark, SF).collect()]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    codes = {i: quality.vote(quality.statistics(t)[5]) for i, t in texts.items()}
    seen = Counter(codes[r.doc_id] for r in rows if r.n_words >= 50)
    model = quality.fit(np.array(list(seen)), np.array(list(seen.values())))
    for r in rows:
        like = [1 - model.good, model.good]
        for k in range(len(quality.RULES)):
            like = [p * model.rates[k, c, codes[r.doc_id] // 3**k % 3] for c, p in enumerate(like)]
        assert abs(r.probability - like[1] / sum(like)) < 1e-6
        assert r.kept == (not r.base_failed and r.probability >= 0.5)


def test_warc_query_against_brute_force(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    last = {}
    for i, raw in pages:
        last[raw] = max(i, last.get(raw, i))
    want = {i: (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if last[raw] == i else "revisit", None if last[raw] == i else last[raw]) for i, raw in pages}
    got = queries.op6_warc(spark, SF).collect()
    assert len(got) == len(pages) and {r.page_id: tuple(r)[1:] for r in got} == want


def test_warc_query_against_sql(spark):
    compare(spark, queries.op6_warc, queries.oracle_sql()["op6_warc"], SF)


def test_token_totals_after_every_batch(spark):
    """The query's batches one by one, against plain sums of what is there after each."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    short, early = {i for i, r in docs.items() if r.n_chars < queries.SHORT_CHARS}, {i for i, r in docs.items() if r.n_chars > queries.LONG_CHARS}
    assert short and early
    roll = tokencounts.Rollup(spark, scratch.fresh(spark, "test"), {"words-v1": tokencounts.word_count})
    frame = lambda ids, text, deleted: spark.createDataFrame([(i, docs[i].source, docs[i].lang, text(i), deleted) for i in ids], "doc_id long, source string, lang string, text string, deleted boolean")
    now = {i: "" if i in early else docs[i].text for i in docs}
    steps = [("load", frame(docs, now.get, False), {}), ("down", frame(short, now.get, True), dict.fromkeys(short)), ("revised", frame(early, lambda i: docs[i].text, False), {i: docs[i].text for i in early}), ("back", frame(short, lambda i: docs[i].text, False), {i: docs[i].text for i in short})]
    for name, changes, after in steps:
        assert roll.apply(name, changes) and not roll.apply(name, changes)
        now |= after
        want = Counter()
        for i, t in now.items():
            if t is not None:
                want[docs[i].source, docs[i].lang] += len(t.encode().split())
        assert {(r.source, r.lang): r.n_tokens for r in roll.totals().collect() if r.n_tokens} == {k: n for k, n in want.items() if n}
    assert now == {i: r.text for i, r in docs.items()}


def test_a_batch_commits_once(spark):
    roll = tokencounts.Rollup(spark, scratch.fresh(spark, "test"))
    assert roll._commit("x", "first", {"batch": "a"}) and not roll._commit("x", "second", {"batch": "a"}) and roll._commit("y", "third", {"batch": "b"})
    assert roll.committed() == {"a": "first", "b": "third"}
    assert roll._commit("z", "both", {"covers": ["a", "b"]}) and roll._commit("w", "fourth", {"batch": "c"}) and roll._commit("v", "fewer", {"covers": ["a"]})
    assert roll.committed() == {"a": "both", "b": "both", "c": "fourth"}


@pytest.mark.parametrize("discard", [False, True])
def test_compaction_changes_no_total(spark, discard):
    make = lambda rows: spark.createDataFrame(rows, "doc_id long, source string, lang string, text string, deleted boolean")
    roll = tokencounts.Rollup(spark, scratch.fresh(spark, "test"), {"words-v1": tokencounts.word_count})
    total = lambda: sorted(((r.source, r.n_docs, r.n_tokens) for r in roll.totals().collect()), key=repr)
    assert not roll.compact()
    assert roll.apply("a", make([(1, "s", "en", "a b c", None), (2, "s", "en", "x", False), (3, "t", "en", "y y", False), (None, "u", None, "n", None)]))
    assert not roll.compact() and roll.apply("b", make([(2, "s", "en", None, True), (1, "t", "en", "a", False)]))
    want = total()
    assert roll.compact(discard) and total() == want and not roll.compact()
    assert len(set(roll.committed().values())) == 1 and set(roll.committed()) == {"a", "b"}
    assert not roll.apply("b", make([(9, "s", "en", "late", False)])) and total() == want
    # Later batches take back what the compacted state holds.
    assert roll.apply("c", make([(1, "t", "en", "a b c d", False), (3, "t", "en", None, True), (2, "s", "en", "back", False)]))
    assert total() == [("s", 1, 1), ("t", 1, 4), ("u", 1, 1)]
    assert roll.compact(discard) and total() == [("s", 1, 1), ("t", 1, 4), ("u", 1, 1)] and set(roll.committed()) == {"a", "b", "c"}
