"""Rules of agreement, segmentation, history and text against plain Python."""

import html
import random
import re

import pytest
from pyspark.sql import functions as F

from parley.functions import scalars
from parley.operators import agreement, release, segments, shaping, text

RATED = "conv_id long, utterance_id long, aspect string, rater_id long, rating int"


def plain_kappa(pairs):
    levels = sorted({v for p in pairs for v in p})
    at = {v: i for i, v in enumerate(levels)}
    seen = sum((at[x] - at[y]) ** 2 for x, y in pairs) / len(pairs)
    chance = sum((at[x] - at[y]) ** 2 for x, _ in pairs for _, y in pairs) / len(pairs) ** 2
    return 1 - seen / chance if chance else float("nan")


def plain_report(rows):
    """(mean, pairs, dropped) by conversation, type and rater, one rater after the other."""
    types, out = {"info": ["A"], "mix": ["N", "R"]}, {}
    for conv in {r[0] for r in rows}:
        for kind, aspects in types.items():
            by = {}
            for c, u, a, r, v in rows:
                if c == conv and a in aspects:
                    by.setdefault(r, {}).setdefault(a, {})[u] = v
            found = {}
            for r in by:
                means, per_aspect = [], {}
                for s in by:
                    each = []
                    for a in aspects if s != r else []:
                        x, y = by[r].get(a, {}), by[s].get(a, {})
                        shared = sorted(x.keys() & y.keys())
                        if len(shared) >= 3:
                            each.append(plain_kappa([(x[u], y[u]) for u in shared]))
                            per_aspect.setdefault(a, []).append(each[-1])
                    if each:
                        means.append(sum(each) / len(each))
                mean = sum(means) / len(means) if means else float("nan")
                low = mean == mean and (mean < 0.3 or any(sum(q) / len(q) < -0.2 for q in per_aspect.values()))
                found[r] = (None if mean != mean else round(mean, 6), len(means), low)
            if sum(not f[2] for f in found.values()) < 2:
                best = sorted(found, key=lambda r: (-(found[r][0] if found[r][0] is not None else -9), -found[r][1], r))[:2]
                found = {r: (*f[:2], r not in best) for r, f in found.items()}
            out |= {(conv, kind, r): f for r, f in found.items()}
    return out


def test_outlier_report_against_plain_python(spark):
    rng = random.Random(11)
    rows = []
    for conv in range(9):
        levels = (1, 2, 4) if conv % 3 else (2,)
        for u in range(rng.randrange(3, 12)):
            base = rng.choice(levels)
            rows += [(conv, u, a, r, base if rng.random() < 0.6 + 0.1 * r else rng.choice(levels)) for a in "ANR" for r in range(rng.randrange(1, 5)) if rng.random() < 0.9]
    got = {(r.conv_id, r.task_type, r.rater_id): (r.mean_qwk, r.n_pairs, r.dropped) for r in agreement.outlier_report(spark.createDataFrame(rows, RATED)).collect()}
    want = plain_report(rows)
    assert got.keys() == want.keys()
    for k, (mean, n, dropped) in want.items():
        assert got[k][1:] == (n, dropped) and (got[k][0] is None) == (mean is None)
        assert mean is None or got[k][0] == pytest.approx(mean, abs=2e-6)
    assert any(d for _, _, d in want.values()) and any(m is None for m, _, _ in want.values())


def test_hard_labels_of_halves_and_ties(spark):
    rows = [(1, 1, "A", 1, 2), (1, 1, "A", 2, 3), (1, 2, "A", 1, 1), (1, 2, "A", 2, 1), (1, 2, "A", 3, 4), (1, 2, "A", 4, 4), (1, 3, "A", 1, 3), (1, 3, "A", 2, 4), (1, 4, "A", 1, 4), (1, 4, "A", 2, 4)]
    got = {r.utterance_id: r for r in agreement.label_rules(spark.createDataFrame(rows, RATED)).collect()}
    # Shares of levels: 1 .2, 2 .1, 3 .2, 4 .5.
    assert [got[1][f"half_{m}"] for m in ("down", "up", "even", "prior", "soft_lower", "soft_upper", "soft_prior")] == [2, 3, 2, 3, 2, 3, 3]
    assert [got[3][f"half_{m}"] for m in ("down", "up", "even", "prior")] == [3, 4, 4, 4]
    assert [got[2][f"tie_{m}"] for m in ("lower", "upper", "prior")] == [1, 4, 4] and got[4].median_then_soft == 4


def plain_starts(scores, tau, least, most):
    n, out, last = len(scores), [0], 0
    peak = [0 < i < n - 1 and s >= tau and s >= scores[i - 1] and s >= scores[i + 1] for i, s in enumerate(scores)]
    while n - 1 - last >= least:
        stop = min(n - 1 - least, n - 2)
        rest = n - 1 - last
        if rest > most:
            stop = min(stop, last + most)
        places = [i for i in range(last + least, stop + 1) if peak[i]]
        if not places and rest > most:
            places = list(range(last + least, stop + 1))
        if not places:
            break
        top = max(scores[i] for i in places)
        last = [i for i in places if scores[i] == top][-1]
        out.append(last)
    return out


def test_segment_starts(spark):
    rng = random.Random(2)
    for _ in range(400):
        scores = [rng.choice([0.0, 0.2, 0.5, 0.7, 1.0]) for _ in range(rng.randrange(0, 40))]
        least, most = rng.randrange(1, 5), rng.randrange(5, 13)
        assert [p for p, _ in segments.choose_starts(scores, 0.5, least, most)] == (plain_starts(scores, 0.5, least, most) if scores else [0])
    starts = spark.createDataFrame([(1, 6), (1, 6), (1, 9), (2, 1)], "conv_id long, idx long")
    sizes = spark.createDataFrame([(1, 10), (2, 2), (3, 1)], "conv_id long, n long")
    scores = segments.votes(starts, 2, sizes)
    assert {(r.conv_id, r.idx): r.score for r in scores.collect()} == {(1, 5): 0.5, (1, 6): 1.0, (1, 7): 0.5, (1, 8): 0.25, (2, 0): 0.25}
    got = sorted(map(tuple, segments.pick_boundaries(scores, sizes, least=2, most=12).collect()))
    assert got == [(1, 0, 0, 6, 1.0), (1, 1, 6, 9, 1.0), (2, 0, 0, 1, 1.0), (3, 0, 0, 0, 1.0)]


def test_history_within_a_budget(spark):
    said = [(1, i, "a", f"{'word ' * n}: not read") for i, n in enumerate((10, 200, 20, 20, 20, 20, 20))]
    got = {r.idx: (r.n_shown, r.first_shown) for r in text.prior_history(spark.createDataFrame(said, "conv_id long, idx int, role string, text string"), 30).collect()}
    # 20 words take 5 seconds, 200 take 50; the first is always shown, the others while time is left after them.
    assert got == {0: (0, None), 1: (1, 0), 2: (1, 1), 3: (1, 2), 4: (2, 2), 5: (3, 2), 6: (4, 2)}


def test_updates_without_a_target_go(spark):
    rows = [(1, 1, 5, "UPDATE"), (1, 2, 5, "UPDATE"), (1, 3, None, "UPDATE"), (1, 4, 5, "ADD"), (1, 5, None, None), (1, 6, None, "NONE")]
    got = release.resolve_updates(spark.createDataFrame(rows, "conv_id long, pos long, target long, action string"))
    assert sorted(r.pos for r in got.collect()) == [2, 4, 5, 6]


def test_markup_as_plain_python_reads_it(spark):
    def plain(s):
        s = re.sub(r"(?s)<!--.*?-->", "", re.sub(r"(?is)<(script|style)\b.*?>.*?</\1>", "", s))
        return " ".join(html.unescape(re.sub(r"<[^>]+>", " ", s)).split())

    texts = ["a<script>x</script>b", "&eacute;&#8364;&amp;lt; x", "<p>1 &lt; 2</p>\n  &nbsp;end ", "no markup", "", "a<!-- b -->c<STYLE type='x'>y</STYLE>d", "&notanentity; & &copy"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scalars.strip_html(F.col("t")).alias("t"))
    assert {r.i: r.t for r in got.collect()} == {i: plain(t) for i, t in enumerate(texts)}


def test_levels_out_of_range_fail(spark):
    df = spark.createDataFrame([("3",), ("x",), (None,)], "rating string")
    assert [r.rating for r in shaping.checked_levels(df).collect()] == [3]
    with pytest.raises(Exception, match="outside 1 to 4"):
        shaping.checked_levels(spark.createDataFrame([("5",)], "rating string")).collect()


def test_markup_with_closed_entities_only(spark):
    texts = ["cut&amp</b>", "&amp;copy; &middot; &#8364;&#x41;", "&notanentity; &amphere; & &am", "&copy &eacute;&amp;amp;", None]
    want = ["cut&amp", "&copy; · €A", "&notanentity; &amphere; & &am", "&copy é&amp;", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", scalars.strip_html(F.col("t"), closed=True).alias("t"))
    assert {r.i: r.t for r in got.collect()} == dict(enumerate(want))


def test_a_kappa_of_the_least_value_stays(spark):
    # The kappa is 0.3 exactly; multiplied in another order it falls below.
    pairs = [(3, 2), (2, 3), (2, 1), (1, 2), (2, 2), (2, 2), (1, 1)]
    fine = [(u, v, v) for u, v in enumerate((1, 2, 3, 1))]
    rows = [(1, u, "A", r, v) for u, p in enumerate(pairs) for r, v in zip((1, 2), p)] + [(1, 50 + u, "A", r, v) for u, *p in fine for r, v in zip((3, 4), p)]
    got = {r.rater_id: (r.mean_qwk, r.dropped) for r in agreement.outlier_report(spark.createDataFrame(rows, RATED)).collect()}
    assert got == {1: (0.3, False), 2: (0.3, False), 3: (1.0, False), 4: (1.0, False)}


def test_nearest_vectors_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(release, "QUERY_BLOCK", 3, raising=False)
    monkeypatch.setattr(release, "MEMORY_BLOCK", 7, raising=False)
    rng = random.Random(4)
    rows = [(i, i % 2, [float(rng.randrange(-3, 4)) for _ in range(4)]) for i in range(160)] + [(200, 0, [0.0] * 4), (201, 0, None), (202, 1, [1.0, None, 0.0, 0.0]), (203, None, [1.0] * 4)]
    vector = {i: (run, v) for i, run, v in rows}
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))

    def score(a, b):
        if any(v is None or None in v or not any(v) for v in (a, b)):
            return None
        return round(dot(a, b) / (dot(b, b) ** 0.5 * dot(a, a) ** 0.5), 5) + 0.0

    want = set()
    for q, (run, v) in vector.items():
        if q % 20 == 0 and run is not None:
            others = sorted(((score(v, o), i) for i, (r, o) in vector.items() if r == run and i != q), key=lambda p: (-(p[0] if p[0] is not None else -9), p[1]))
            want |= {(q, i, s, k + 1) for k, (s, i) in enumerate(others[:3])}
    frame = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {tuple(r) for r in release.vector_top_k(frame, 3).collect()} == want
