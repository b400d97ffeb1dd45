"""Operators over whole texts and all rows."""

from parley import registry
from parley.operators import claims, text


def test_context_keeps_whole_texts(spark):
    said = [(1, 0, "a", "x" * 500), (1, 1, "b", "y" * 41), (1, 2, "a", "end")]
    rows = spark.createDataFrame(said, "conv_id long, idx int, role string, text string")
    got = {r.idx: r.context for r in text.context(rows).collect()}
    assert got == {0: "No Context", 1: f"a: {'x' * 500}", 2: f"a: {'x' * 500}\nb: {'y' * 41}"}
    assert {r.idx: r.context for r in text.context(rows, None).collect()} == got
    assert {r.idx: r.context for r in text.context(rows, 1).collect()}[2] == f"b: {'y' * 41}"
    assert {r.context for r in text.context(rows, 0).collect()} == {"No Context"}
    longest = max(r.n_chars for r in registry.queries()["context_window"](spark, "/root/testdata/sf0.001").collect())
    assert longest > 3 * 60


def test_memory_lines_hold_every_turn_without_a_cutpoint(spark):
    rows = spark.createDataFrame([(1, 5, "a", "x"), (1, 901, "b", "y"), (1, 7, None, "z")], "conv_id long, turn_id long, speaker string, claim string")
    whole, cut = (claims.memory_lines(rows, c).first().memories for c in (-1, 6))
    assert whole == '- (Turn #5) a: "x"\n- (Turn #7) Unknown: "z"\n- (Turn #901) b: "y"\n'
    assert cut == '- (Turn #5) a: "x"\n'
    turns = spark.read.parquet("/root/testdata/sf0.001/lineitem.parquet").select("l_orderkey", "l_linenumber").distinct().count()
    said = sum(r.n_chars for r in registry.queries()["memory_lines"](spark, "/root/testdata/sf0.001").collect())
    assert said > turns * len('- (Turn #1) ADD: ""')
