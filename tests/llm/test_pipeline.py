"""The pipeline's stages, each on what its predecessor kept, against brute force."""

import os

import corpus_pipeline
import numpy as np

from parley.llm import scratch, similar, suffix, toxicity
from tests.llm.test_near_and_exact import SF, slow_leaks
from tests.llm.test_others import check_packing
from tests.llm.test_similar import slow_kept


def slow_cut(rows, length=50):
    first, out = {}, {}
    for i, t in sorted(rows):
        for p in range(len(t) - length + 1):
            first.setdefault(t[p : p + length], i)
    for i, t in rows:
        gone = np.zeros(len(t), dtype=bool)
        for p in range(len(t) - length + 1):
            if first[t[p : p + length]] < i:
                gone[p : p + length] = True
        out[i] = bytes(np.frombuffer(t, dtype=np.uint8)[~gone]).decode("utf-8", "ignore")
    return out


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    want = {r.doc_id: r.text for r in docs.collect() if model.score(r.text) < 0.5}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        before, docs = docs, scratch.write_and_read(stage(spark, docs, SF), "stage")
        if k == 1:
            kept = slow_kept(list(want.items()))
            want = {i: t for i, t in want.items() if i in kept}
        elif k == 2:
            want = slow_cut([(i, t.encode()) for i, t in want.items()])
        elif k == 3:
            leaks = {d for d, _ in slow_leaks(list(want.items()), items)}
            want = {i: t for i, t in want.items() if i not in leaks}
        if k < 4:
            assert docs.columns == before.columns
            assert {r.doc_id: r.text for r in docs.collect()} == want
    check_packing(docs.collect(), list(want.items()))


def test_stages_leave_no_tables(spark, monkeypatch):
    monkeypatch.setattr(similar, "BUNDLE_ROWS", 64)
    monkeypatch.setattr(suffix, "SHARD_BYTES", 1 << 14)
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 150")
    made = []
    with scratch.noting(made):
        near = similar.one_of_each(docs)
        near.collect()
    names = [p.rsplit("/", 1)[1].rsplit("-", 1)[0] for p in made]
    assert names.count("meeting") == similar.PARTS  # a part of the rows is on disk at once
    left = {n for p, n in zip(made, names, strict=True) if os.path.exists(p.removeprefix("file:"))}
    assert not left & {"marks", "meeting", "candidates", "texts", "nodes", "near"}
    assert {r.doc_id for r in near.collect()} == slow_kept([(r.doc_id, r.text) for r in docs.collect()])
    made.clear()
    with scratch.noting(made):
        cut = suffix.without_repeats(docs)
    assert sum("answers" in p for p in made) == suffix.ASKS
    assert {r.doc_id: r.text for r in cut.collect()} == slow_cut([(r.doc_id, r.text.encode()) for r in docs.collect()])
    made.clear()
    with scratch.noting(made):
        out = corpus_pipeline.run(spark, SF)
    assert [p for p in made if os.path.exists(p.removeprefix("file:"))] == [out.scratch_path]
    assert out.count() > 0


def test_heaps_are_collected_between_steps(spark, monkeypatch):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName())

    before = collections()
    scratch.shrink(spark)
    assert collections() > before
    swept = []
    monkeypatch.setattr(scratch, "sweep", swept.append)
    for _, stage in corpus_pipeline.STAGES:
        swept.clear()
        stage(spark, spark.read.parquet(f"{SF}/documents.parquet").limit(40), SF)
        assert swept
