"""Hot keys, patches and the change log against plain Python."""

import random

from pyspark.sql import functions as F

from sparkscour.operators import patches as P
from sparkscour.session import join_hot, salts_of
from sparkscour.sources.contracts import ColumnRule


def test_hot_keys_are_spread_and_nothing_is_lost(spark):
    rng = random.Random(1)
    many = spark.createDataFrame(
        [(i, 7 if i % 3 == 0 else rng.randint(0, 40)) for i in range(3000)], "i long, k int"
    )
    one = spark.createDataFrame([(k, f"v{k}") for k in range(0, 45, 2)] + [(7, "hot")], "k int, v string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        plain = sorted(map(repr, many.join(one, "k", how).collect()))
        salted = join_hot(many, one, "k", how, spread_by=F.col("i"), hot_rows=50)
        assert sorted(map(repr, salted.collect())) == plain, how
    weights = many.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    by_weight = join_hot(many, one, "k", spread_by=F.col("i"), hot_rows=50, measured=weights, weight="n")
    assert "_salt" in by_weight._jdf.queryExecution().toString()
    assert by_weight.count() == many.join(one, "k").count()


def test_no_side_of_a_hot_join_is_sent_whole(spark):
    """Both sides are tiny here, as rows that were listed from a small file are to Spark's estimate."""
    many = spark.range(300).selectExpr("id AS i", "id % 7 AS k")
    one = spark.range(5).selectExpr("id AS k", "concat('v', id) AS v")
    for hot_rows in (10, 1000):
        for how in ("inner", "left", "left_semi", "left_anti"):
            joined = join_hot(many, one, "k", how, spread_by=F.col("i"), hot_rows=hot_rows)
            plan = joined._jdf.queryExecution().executedPlan().toString()
            assert "SortMergeJoin" in plan and "Broadcast" not in plan, (how, hot_rows)


def test_salts_grow_with_the_bucket():
    assert salts_of({1: 10, 2: 101, 3: 450}, 100) == {2: [2], 8: [3]}


def sequential(cells, patches):
    """Apply patches one after the other, as they come."""
    cells, log = dict(cells), []
    for row, column, value, source, seq in sorted(patches, key=lambda p: (p[3], p[4])):
        if (row, column) in cells:
            now = cells[row, column] or ""
            log.append((row, column, source, seq, now, value, now != value))
            cells[row, column] = value
    return cells, log


def test_change_log_and_patches_match_the_sequential_loop(spark, monkeypatch):
    rng = random.Random(3)
    table = [(i, rng.choice(["a", "b", None]), rng.choice(["x", ""])) for i in range(1, 30)]
    df = spark.createDataFrame(table, "row_id long, p string, q string")
    patches, used = [], set()
    for n in range(600):
        source, seq = f"f{rng.randint(0, 3)}", rng.randint(1, 400)
        if (source, seq) not in used:
            used.add((source, seq))
            row = 5 if n % 3 == 0 else rng.randint(-2, 35)
            patches.append((row, rng.choice("ppqz"), rng.choice(["a", "x", "y", ""]), source, seq))
    cp = spark.createDataFrame(patches, "row_id long, column string, corrected_value string, source string, seq long")
    cells = {(r, c): v for r, p, q in table for c, v in (("p", p), ("q", q))}
    final, log = sequential(cells, patches)
    for stretch in (100_000, 7):
        monkeypatch.setattr(P, "LOG_STRETCH", stretch)
        got = P.build_change_log(df, cp)
        assert sorted(tuple(r) for r in got.collect()) == sorted(log)
    patched = {(r["row_id"], c): r[c] for r in P.apply_cell_patches(df, cp).collect() for c in "pq"}
    assert patched == final


def test_row_patches_short_long_repeated(spark):
    df = spark.createDataFrame([(1, "a", "b"), (2, "a", "b"), (3, "a", "b")], "row_id long, p string, q string")
    rp = spark.createDataFrame(
        [(1, ["x"], False, 1), (2, ["1", "2", "3"], False, 2), (2, ["9"], True, 3), (9, ["z"], False, 4)],
        "row_id long, values array<string>, flagged boolean, seq long",
    )
    got = {tuple(r) for r in P.apply_row_patches(df, rp).collect()}
    assert got == {(1, "x", "b"), (2, "9", "b"), (3, "a", "b")}
    empty = spark.createDataFrame([], "row_id long, column string, corrected_value string, source string, seq long")
    both = P.patched_side_by_side(df, rp, empty).collect()
    assert {(r[0], *r["_before"]) for r in both} == got == {(r[0], *r["_after"]) for r in both}


def test_patches_without_column_source_or_place(spark):
    df = spark.createDataFrame([(1, "a", "b")], "row_id long, p string, q string")
    cp = spark.createDataFrame(
        [(1, None, "x", "f", 1), (1, "p", "y", None, 1), (1, "p", "z", "f", None), (1, "p", "w", "f", 2)],
        "row_id long, column string, corrected_value string, source string, seq long",
    )
    assert [tuple(r) for r in P.apply_cell_patches(df, cp).collect()] == [(1, "w", "b")]
    log = P.build_change_log(df, cp).collect()
    assert {(r["source"], r["seq"], r["current_value"], r["corrected_value"]) for r in log} == {
        (None, 1, "a", "y"), ("f", None, "y", "z"), ("f", 2, "z", "w")
    }


def test_blank_and_repeated_rule_names(spark):
    log = spark.createDataFrame([(1, "p", "f", 1, "a", "b", True)], "row_id long, column string, source string, seq long, current_value string, corrected_value string, needs_change boolean")
    bad = spark.createDataFrame([(1, "p", "b")], "row_id long, column string, value string")
    rules = [ColumnRule("x", "", index=1), ColumnRule("p", "p", index=2, regex="^1"), ColumnRule("r", "p", index=3, regex="^1")]
    assert P.flag_unresolved(log, bad, rules).first()["status"] == "FLAGGED"


def test_flags_follow_the_final_value(spark):
    log = spark.createDataFrame(
        [(1, "p", "f", 1, "a", "b", True), (2, "p", "f", 2, "c", "c", False)],
        "row_id long, column string, source string, seq long, current_value string, corrected_value string, needs_change boolean",
    )
    bad = spark.createDataFrame([(1, "p", "b"), (7, "q", "z")], "row_id long, column string, value string")
    rules = [ColumnRule("p", "p", index=1, regex="^1"), ColumnRule("q", "q", index=2, regex="^2")]
    got = {(r["row_id"], r["status"], r["source"], r["flag_reason"]) for r in P.flag_unresolved(log, bad, rules).collect()}
    assert got == {
        (1, "FLAGGED", "f", "Value 'b' does not match regex: ^1"),
        (2, "VALID", "f", ""),
        (7, "FLAGGED", P.VALIDATION_SOURCE, "Value 'z' does not match regex: ^2"),
    }
