"""Validation of memory updates against a plain loop."""

import random
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from parley.operators import validation

MEMORY = "conv_id long, id string, speaker string, target_speaker string, claim string, turn_id string"
UPDATE = "conv_id long, pos long, action string, relation string, source struct<speaker:string,target_speaker:string,claim:string,turn_id:string>, target struct<id:string,speaker:string,target_speaker:string,claim:string,turn_id:string>"
VOCABULARY = {"equivalent": "NONE", "forward_entail": "UPDATE", "backward_entail": "NONE", "contradiction": "UPDATE", "neutral": "ADD"}


def lookup(speaker, claim, memories):
    claim = (claim or "").strip()
    for fits in (lambda m: (m[4] or "").strip() == claim and m[2] == (speaker or None), lambda m: (m[4] or "").strip() == claim):
        found = [m for m in memories if fits(m)]
        if len(found) == 1:
            return found[0][1:]
    if not claim:
        return None
    ratio = lambda m: SequenceMatcher(None, claim.lower(), (m[4] or "").strip().lower()).ratio()
    best = max(sorted(memories, key=lambda m: m[1]), key=ratio, default=None)
    return best[1:] if best and ratio(best) >= 0.9 else None


def poor(t):
    return not t[0] or not t[1] or any(not (v or "").strip() for v in t[2:])


def plain(updates, memories):
    """(pos, action, target id, number of errors, kept) with repair, one update after the other."""
    out, ids = [], {m[1] for m in memories}
    for _, pos, action, relation, source, target in updates:
        speaker, _, claim, turn = source
        up = {"AD D": "ADD", "UPD": "UPDATE"}.get((action or "").strip().upper(), (action or "").strip().upper())
        known = up if up in ("ADD", "UPDATE", "NONE") else None
        rel = (relation or "").strip().lower()
        errors = (known is None) + (rel not in VOCABULARY) + (not speaker) + (not (claim or "").strip()) + (not (turn or "").strip())
        bad = known in ("UPDATE", "NONE") if target is None else poor(target) or target[0] not in ids
        if bad:
            found = lookup(speaker, claim, memories)
            if found:
                target = found
            elif target is not None and not poor(target) and known == "ADD":
                target = None
            else:
                errors += 1
        final = known if known else action
        if target and target[1] and speaker:
            if target[1] != speaker and known in ("UPDATE", "NONE"):
                final = "ADD"
            elif target[1] == speaker and rel in VOCABULARY:
                final = VOCABULARY[rel]
        out.append([pos, final, target and target[0], errors, (speaker or "", claim, turn), speaker or None])
    seen, claims, rows = set(), set(), []
    for pos, final, target, errors, key, speaker in out:
        kept = True
        if final == "UPDATE" and target is not None:
            kept = (speaker, target) not in seen
            seen.add((speaker, target))
        if kept:
            kept = key not in claims
            claims.add(key)
        rows.append((pos, final, target, errors, kept))
    return rows


def sample(seed):
    rng = random.Random(seed)
    claim = lambda: rng.choice(["Taxes should rise a little every year", "Taxes should rise a little every years", "Buses are late", " Buses are late", "Short", "", None])
    who = lambda: rng.choice(["Ann", "Ben", "Ann", "", None])
    memories = [(1, f"m{i}", who(), rng.choice(["Cy", "", None]), claim(), rng.choice(["4", "5"])) for i in range(rng.randint(0, 6))]
    target = lambda: rng.choice([None, None, (f"m{rng.randint(0, 8)}", who(), "Cy", claim(), "4"), ("m0", "Ann", "Cy", "Short", "2"), ("", "Ann", "Cy", "x", "1")])
    updates = [(1, i, rng.choice(["ADD", " add", "UPD", "UPDATE", "NONE", "gone", None]), rng.choice([*VOCABULARY, " Neutral", "odd", None]), (who(), "Cy", claim(), rng.choice(["4", "5", ""])), target()) for i in range(12)]
    return memories, updates


def test_repair_matches_a_plain_loop(spark):
    all_memories, all_updates, want = [], [], []
    for conv in range(40):
        memories, updates = sample(conv)
        all_memories += [(conv, *m[1:]) for m in memories]
        all_updates += [(conv, *u[1:]) for u in updates]
        want += [(conv, *r) for r in plain(updates, memories)]
    memories, updates = spark.createDataFrame(all_memories, MEMORY), spark.createDataFrame(all_updates, UPDATE)
    got = [(r.conv_id, r.pos, r.action, r.target and r.target.id, len(r.errors), r.kept) for r in validation.validate(updates, memories).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    assert {r.step for r in validation.resolve_targets(updates.select("conv_id", "pos", "source.speaker", "source.claim"), memories).collect()} == {"speaker", "claim", "likeness"}


def test_reports_without_repair(spark):
    memories = spark.createDataFrame([(1, "m0", "Ann", "Cy", "Buses are late", "3")], MEMORY)
    good = ("m0", "Ann", "Cy", "Buses are late", "3")
    said = ("Ann", "Cy", "They are probably late and slow", "4")
    rows = [(1, 0, "UPDATE", "contradiction", said, good), (1, 1, " update", "neutral", said, None), (1, 2, "NONE", "equivalent", ("Ben", "Cy", "Buses are late", "5"), good), (1, 3, "ADD", "neutral", ("Ann", " ", "New", "6"), ("m9", *good[1:])), (1, 4, "ADD", "equivalent", ("Ann", "Cy", "Also", "7"), good), (1, 5, "UPDATE", "neutral", ("Ann", None, "X", "8"), None)]
    updates = spark.createDataFrame(rows, UPDATE)
    got = {r.pos: r for r in validation.validate(updates, memories, fix=False).collect()}
    assert {p: list(r.errors) for p, r in got.items()} == {0: [], 1: ["second update"], 2: ["other speaker"], 3: ["source target speaker", "unknown target"], 4: ["same speaker"], 5: ["missing target"]}
    assert list(got[0].warnings) == ["pronoun", "hedge", "several"]
    assert all(r.kept for r in got.values())
    claims = spark.createDataFrame([(1, "Ann", "Also", "7"), (1, "Ann", "Unsaid", "9"), (2, None, None, None)], "conv_id long, speaker string, claim string, turn_id string")
    fixed = validation.validate(updates, memories)
    assert sorted((r.conv_id, r.claim) for r in validation.without_update(claims, fixed).collect()) == [(1, "Unsaid"), (2, None)]
    totals = {r.conv_id: r for r in validation.summary(fixed, memories, claims).collect()}
    assert (totals[1].n_existing, totals[1].n_new_claims, totals[1].n_updates, totals[2].n_updates, totals[2].ok) == (1, 2, 5, 0, True)


def test_empty_tables(spark):
    memories, updates = spark.createDataFrame([], MEMORY), spark.createDataFrame([], UPDATE)
    assert validation.validate(updates, memories).collect() == []
    assert validation.resolve_targets(updates.select("conv_id", "pos", "source.speaker", "source.claim"), memories).collect() == []


def test_equal_claims_need_no_likeness(spark, monkeypatch):
    # Three memories share a claim but for its case; many updates name it, two another that is like it.
    monkeypatch.setattr(validation, "similarity", lambda a, b: F.when(a == b if not isinstance(a, str) else F.col(a) == F.col(b), F.raise_error(F.lit("equal claims compared")).cast("double")).otherwise(0.95))
    memories = spark.createDataFrame([(1, f"m{i}", "x", "all", c, "1") for i, c in enumerate(["THE TAX IS TOO HIGH", "the tax is too high", "the tax is too high"])], "conv_id long, id string, speaker string, target_speaker string, claim string, turn_id string")
    wanted = spark.createDataFrame([(1, p, "y", "the tax is too high" if p < 50 else "the tax is too hugh") for p in range(52)], "conv_id long, pos long, speaker string, claim string")
    got = validation.resolve_targets(wanted, memories).select("pos", "found.id", "step").collect()
    assert sorted(map(tuple, got)) == [(p, "m0", "likeness") for p in range(52)]


def test_conversations_that_lie_together_stay(spark):
    """With conversations dealt to a number of partitions, only claims to compare and what is found for them are shuffled."""
    all_memories, all_updates, want = [], [], []
    for conv in range(40):
        memories, updates = sample(conv + 100)
        all_memories += [(conv, *m[1:]) for m in memories]
        all_updates += [(conv, *u[1:]) for u in updates]
        want += [(conv, *r) for r in plain(updates, memories)]
    no_one = (None, "m0", "Ann", "Cy", "Short", "4")  # of no conversation
    memories, updates = (spark.createDataFrame(r, t).repartition(3, "conv_id") for r, t in (([*all_memories, no_one], MEMORY), (all_updates, UPDATE)))
    out = validation.validate(updates, memories, parts=3)
    assert sorted([(r.conv_id, r.pos, r.action, r.target and r.target.id, len(r.errors), r.kept) for r in out.collect()], key=repr) == sorted(want, key=repr)
    shuffled = [x for x in out._jdf.queryExecution().sparkPlan().toString().splitlines() if " Join" in x or "Join [" in x]
    assert len(shuffled) == 1  # the claims compared; the windows below deal nothing out anew
    plan = out._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("hashpartitioning(conv_id") - plan.count(", 3), REPARTITION_BY_NUM") <= 3
