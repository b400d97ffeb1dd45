"""Key phrases, their clusters and their marks against loops and patterns."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from parley.operators import groups, phrases
from parley.plans.phrases import _marked, _shared, _told


def pattern(phrase):
    """A phrase as one pattern over a text."""
    words = [w for w in re.split(r"[\s-]+", re.sub(r"\bper\s+cent\b", "percent", phrase.strip().lower())) if w]
    if not words:
        return None

    def piece(w):
        if w == "percent":
            return r"(?:percent|per\s*cent|%)"
        if len(w) > 3 and re.search("[^aeiou]y$", w):
            return f"(?:{re.escape(w)}|{re.escape(w[:-1])}ies)"
        return re.escape(w) + ("s?" if len(w) > 2 and not w.endswith("ss") else "")

    return re.compile(rf"(?<!\w)(?:\b(?:the|a|an)\s+)?{r'(?:\s+|[-–—]\s*)'.join(map(piece, words))}(?:['’]s)?(?!\w)", re.IGNORECASE)


def slow_marks(text, found):
    spans = set()
    for p in filter(None, map(pattern, found)):
        at = 0
        while m := p.search(text, at):  # occurrences that overlap too
            spans.add(m.span())
            at = m.start() + 1
            while at < len(text) and re.match(r"\w", text[at]) and re.match(r"\w", text[at - 1]):
                at += 1
    kept = []
    for s, e in sorted(spans, key=lambda s: (s[0] - s[1], s[0])):
        if all(e <= a or s >= b for a, b in kept):
            kept.append((s, e))
    for s, e in sorted(kept, reverse=True):
        text = f"{text[:s]}<strong>{text[s:e]}</strong>{text[e:]}"
    return text, len(kept)


CASES = [
    ("The national academy's plan", ["national academy"], "<strong>The national academy's</strong> plan"),
    ("Cities and a city-state", ["city", "city state"], "<strong>Cities</strong> and <strong>a city-state</strong>"),
    ("ten per cent, 10 % or 5 percent", ["percent", "5 percent"], "ten <strong>per cent</strong>, 10 <strong>%</strong> or <strong>5 percent</strong>"),
    ("a grass roof, class", ["class", "roof"], "a grass <strong>roof</strong>, <strong>class</strong>"),
    ("taxes tax taxi", ["tax", " ", ""], "taxes <strong>tax</strong> taxi"),
    ("10% %x super cent", ["percent", "cent"], "10% %x super <strong>cent</strong>"),
    ("It’s Donohue’s  An apple", ["donohue", "apple"], "It’s <strong>Donohue’s</strong>  <strong>An apple</strong>"),
    ("nothing", [], "nothing"),
    ("", ["x"], ""),
    (None, ["x"], None),
]


def marked(spark, cases):
    texts = spark.createDataFrame([(i, 0, t) for i, (t, *_) in enumerate(cases)], "g long, id long, text string")
    found = spark.createDataFrame([(i, p) for i, (_, ps, *_) in enumerate(cases) for p in ps], "g long, phrase string")
    return {r.g: (r.text, r.n_marks) for r in phrases.mark_phrases(texts, found, ["g"], ["g", "id"]).collect()}


def test_marks(spark):
    assert {g: t for g, (t, _) in marked(spark, CASES).items()} == {i: want for i, (*_, want) in enumerate(CASES)}


def test_marks_against_a_pattern_for_each_phrase(spark):
    rng = random.Random(3)
    words = ["city", "cities", "state", "states", "the", "a", "per cent", "percent", "%", "class", "Tax", "tax's", "go", "gos", "toy", "toys", "bus", "buses", "é"]
    between = [" ", "  ", "-", "- ", " - ", ", ", "–", "\n"]
    cases = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice(between) for _ in range(rng.randrange(1, 14)))
        cases.append((text, [rng.choice([" ", "-"]).join(rng.choice(words[:-1]).replace("'s", "") for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(0, 4))]))
    got = marked(spark, cases)
    for i, (text, found) in enumerate(cases):
        assert got[i] == slow_marks(text, found), (text, found)


def test_query_marks_what_patterns_mark(spark):
    sf = "/root/testdata/sf0.001"
    found = {}
    for r in _shared(spark, sf).collect():
        found.setdefault((r.conv_id, r.segment_id), []).append(r.phrase)
    want = {}
    for r in _told(spark, sf).collect():
        text, n = slow_marks(r.text, found.get((r.conv_id, r.segment_id), []))
        want[r.conv_id, r.segment_id, r.idx] = (n, hashlib.md5(text.encode()).hexdigest())
    got = {(r.conv_id, r.segment_id, r.idx): (r.n_marks, r.text) for r in _marked(spark, sf).collect()}
    assert got == want and sum(n for n, _ in got.values()) > 0


def slow_key_phrases(candidates, stops, likeness):
    """Clusters by comparing all pairs, again and again; parts by comparing all."""
    canon = {phrases_canonical(p, stops) for p in candidates} - {None}
    items = [(c, {w for w in c.split(" ") if w != "of"}) for c in sorted(canon)]
    root = list(range(len(items)))
    changed = True
    while changed:
        changed = False
        for i, (_, a) in enumerate(items):
            for j, (_, b) in enumerate(items):
                if len(a & b) >= likeness * len(a | b) - 1e-9 and root[i] != root[j]:
                    root[i] = root[j] = min(root[i], root[j])
                    changed = True
    reps = {min((c for k, (c, _) in enumerate(items) if root[k] == r), key=lambda c: (-len(c), c)) for r in set(root)}
    return {r for r in reps if not any(r != o and r in o for o in reps)}


def phrases_canonical(p, stops):
    s = re.sub(r"\s+", " ", re.sub("-+", " ", re.sub(r"[-\s]*[-,.:;]+$", "", p.translate(str.maketrans("’–—", "'--")).strip()))).lower()
    t = [w for w in re.sub(r"\b([a-z]+)'s\b", r"\1", s).split(" ") if w]
    t = t[1:] if len(t) > 1 and t[0] in phrases.ARTICLES else t
    t = [phrases.NUMBERS.get(w, w) for w in t if w == "of" or w not in stops]
    while len(t) > 1 and t[-1] == "of":
        t.pop()
    out = " ".join(t)
    good = out not in ("", "of") and s not in phrases.EMPTY_PHRASES and (len(out) >= 3 or out.upper() == out)
    return out if good else None


def test_key_phrases_against_all_pairs(spark):
    rng = random.Random(4)
    words = ["national", "academy", "of", "sciences", "seventy", "tax", "reform", "the", "plan", "policy", "new", "about", "x", "5", "Donohue's", "long-term"]
    rows = [(g, " ".join(rng.choice(words) for _ in range(rng.randrange(1, 7))) + rng.choice(["", ".", " -", "’s"])) for g in range(8) for _ in range(25)]
    rows += [(1, None), (1, ""), (2, "A lot"), (2, "the view"), (3, "National Academy"), (3, "The National Academy of Sciences"), (9, "of"), (9, "it")]
    got = {}
    for r in phrases.key_phrases(spark.createDataFrame(rows, "g long, phrase string"), ["g"]).collect():
        assert r.phrase not in got.setdefault(r.g, set())
        got[r.g].add(r.phrase)
    for g in range(10):
        assert got.get(g, set()) == slow_key_phrases([p for k, p in rows if k == g and p is not None], phrases.STOPS, phrases.LIKENESS)
    assert phrases.key_phrases(spark.createDataFrame([], "g long, phrase string"), ["g"]).count() == 0


def test_connected_groups(spark):
    links = [(i, i + 1) for i in range(0, 60)] + [(100, 200), (200, 150), (7, 7), (300, 301), (301, 300)]
    got = {r.node: r.root for r in groups.connected(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | {100: 100, 200: 100, 150: 100, 300: 300, 301: 300}
    assert groups.connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_shared(spark):
    rows = spark.createDataFrame([(1, ["big tax", "zz"], ["tax", "xyz"]), (2, ["b"], []), (3, None, None)], "id long, target array<string>, context array<string>")
    got = {r.id: r.shared for r in rows.select("id", phrases.shared_phrases(F.col("target"), F.col("context")).alias("shared")).collect()}
    assert got == {1: ["tax", "xyz"], 2: [], 3: None}
    assert rows.select(phrases.shared_phrases(F.array(F.lit("q")), F.array(F.lit("w"))).alias("x")).first().x == []


def test_short_phrases_inside_longer_ones_are_dropped(spark):
    rows = [(1, "42"), (1, "42 cats sleep"), (1, "7"), (1, "é7 wide doors"), (2, "42"), (2, "9"), (2, "%"), (2, "12% growth")]
    got = {(r.g, r.phrase) for r in phrases.key_phrases(spark.createDataFrame(rows, "g long, phrase string"), ["g"]).collect()}
    assert got == {(1, "42 cats sleep"), (1, "é7 wide doors"), (2, "42"), (2, "9"), (2, "12% growth")}
