"""Batches, splits and the isolation forest against plain Python."""

import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkscour.operators import outliers as O
from sparkscour.operators import split as S
from sparkscour.operators import batches as B
from sparkscour.operators.batches import ask_corrector, correct_cells, decide_groups, plan_batches
from sparkscour.plans.isosplit import iso_split
from sparkscour.session import durable
from sparkscour.sources.contracts import ColumnRule


def quoted(value):
    return '"' + value.replace('"', '""') + '"' if any(c in value for c in ',"\n') else value


def sequential_batches(rows, column, limit, overhead, most):
    def tokens(part):
        csv = "\n".join([f"ID,{column}", *[f"{i},{quoted(v)}" for i, v in part]])
        return math.ceil(len(f"Schema: \nSemantic Diff: \nData: {csv}") / 4) + overhead

    k = 1
    if tokens(rows) > limit:
        k = 2
        while k < most and tokens(rows[: math.ceil(len(rows) / k)]) > limit:
            k += 1
    per = math.ceil(len(rows) / k)
    return {i: (n // per + 1, k) for n, (i, _) in enumerate(rows)}


@pytest.mark.parametrize("limit", [10, 60, 150, 400, 100_000])
def test_batches_match_the_sequential_plan(spark, limit):
    rng = random.Random(2)
    cells = [(i, "hot" if i % 3 else "b", 'x,"' * rng.randint(0, 20)) for i in rng.sample(range(1, 900), 200)]
    df = spark.createDataFrame(cells, "row_id long, column string, value string")
    got = {r["row_id"]: (r["batch"], r["batches"]) for r in plan_batches(df, limit, 5, 20).collect()}
    want = {}
    for name in ("hot", "b"):
        rows = sorted((i, v) for i, c, v in cells if c == name)
        want |= sequential_batches(rows, name, limit, 5, 20)
    assert got == want


def test_all_batches_fit_the_limit(spark):
    rows = [(i, "c", "x" * (3000 if i > 150 else 5)) for i in range(1, 201)]
    df = spark.createDataFrame(rows, "row_id long, column string, value string")
    got = sorted((r["batch"], r["row_id"], len(r["value"])) for r in plan_batches(df, 5000, 5).collect())
    for batch in {b for b, _, _ in got}:
        chars = sum(len(f"{i},") + n + 1 for b, i, n in got if b == batch)
        assert math.ceil((31 + len("ID,c") + chars) / 4) + 5 <= 5000
    assert [b for b, _, _ in got] == [b for b, _, _ in sorted(got, key=lambda r: r[1])]
    assert {b for b, _, _ in got} == set(range(1, max(got)[0] + 1))


def test_failed_calls_are_reported_and_give_no_patches(spark):
    cells = spark.createDataFrame([(i, "c" if i % 2 else "d", f"v{i}") for i in range(1, 200)], "row_id long, column string, value string")
    rules = [ColumnRule("C", "c", index=1, regex="x"), ColumnRule("D", "d", index=2, regex="y"),
             ColumnRule("E", "", index=3), ColumnRule("F", "", index=4)]

    def corrector(part, context):
        if context["rule"]["name"] == "d":
            raise RuntimeError("down")
        head, line = context["schema"].split("\n")
        assert head.startswith("data_title,") and line.startswith("c,") and context["examples"] == "1,a"
        return part.assign(corrected_value=part["value"] + context["rule"]["regex"])

    patches, failed = ask_corrector(cells, rules, corrector, examples={"c": "1,a"})
    got = patches.collect()
    assert sorted(r["row_id"] for r in got) == list(range(1, 200, 2))
    assert {r["corrected_value"] for r in got} == {f"v{i}x" for i in range(1, 200, 2)}
    assert {r["source"] for r in got} == {"c_batch_1"}
    assert [tuple(r) for r in failed.collect()] == [("d", 1, 99, "RuntimeError: down")]
    assert correct_cells(cells.filter("row_id < 0"), rules, corrector).count() == 0


def test_failed_decider_has_no_reply(spark):
    asked = spark.createDataFrame([(1, 1, "a"), (2, 1, "b")], "leader_id long, part long, text string")

    def decider(text):
        if text == "b":
            raise RuntimeError("down")
        return text.upper()

    assert [tuple(r) for r in decide_groups(asked, decider).collect()] == [(1, 1, "A")]


@pytest.mark.parametrize("n,bucket", [(0, 100_000), (1, 100_000), (7, 100_000), (1000, 100_000), (5000, 3)])
def test_exact_split(spark, monkeypatch, n, bucket):
    monkeypatch.setattr(S, "BUCKET_ROWS", bucket)
    order = sorted(range(n), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    train, validate = math.floor(n * 0.70), math.floor(n * 0.15)
    want = {i: "train" if p < train else "validate" if p < train + validate else "test" for p, i in enumerate(order)}
    for parts in (1, 5):
        df = spark.range(n).withColumnRenamed("id", "row_id").repartition(parts)
        got = {r["row_id"]: r["split"] for r in S.split_rows(df, seed=9).collect()}
        assert got == want


def numbers(spark, n=2000, parts=3):
    rng = random.Random(4)
    rows = [(i, rng.gauss(0, 1), rng.gauss(5, 2), 1.0) for i in range(1, n + 1)]
    rows[n // 2] = (n // 2 + 1, 90.0, -80.0, 1.0)
    return spark.createDataFrame(rows, "row_id long, a double, b double, same double").repartition(parts)


def test_sums_before_of_many_levels(spark, monkeypatch):
    monkeypatch.setattr(B, "FAN", 3)
    rng = random.Random(8)
    sums = {(c, k): rng.randrange(100) for c, n in (("a", 100), ("b", 1), ("c", 31)) for k in range(n) if k % 7 or c == "b"}
    df = spark.createDataFrame([(*k, v) for k, v in sums.items()], "column string, _stretch long, _sum long")
    got = {(r["column"], r["_stretch"]): r["_before"] for r in B.sums_before(df).collect()}
    assert got == {(c, k): sum(v for (d, j), v in sums.items() if d == c and j < k) for c, k in sums}
    assert B.sums_before(df.limit(0)).count() == 0


def test_short_stretches_do_not_change_batches(spark, monkeypatch):
    rng = random.Random(3)
    df = durable(spark.createDataFrame([(i, "ab"[i % 3 == 0], "x" * rng.randrange(200)) for i in range(1, 400)], "row_id long, column string, value string"))
    want = [sorted(map(tuple, plan_batches(df, 2500, 5, most).collect())) for most in (None, 20)]
    monkeypatch.setattr(B, "STRETCH", 7)
    monkeypatch.setattr(B, "FAN", 4)
    assert [sorted(map(tuple, plan_batches(df, 2500, 5, most).collect())) for most in (None, 20)] == want
    assert max(r[3] for r in want[0]) > 4


def test_the_forest_draws_the_rows_with_the_smallest_numbers(spark):
    df = numbers(spark)
    nodes = O.iforest_fit(df, ["a", "b"], trees=7, sample=50, seed=5).collect()
    rows = [(r["row_id"], r["a"], r["b"]) for r in df.collect()]

    def digits(text, first):
        return int(hashlib.md5(text.encode()).hexdigest()[first : first + 12], 16)

    for tree in range(7):
        drawn = sorted(rows, key=lambda r: ((digits(f"5:{r[0]}", 0) + tree * digits(f"5:{r[0]}", 12)) % 2**48, r[0]))[:50]
        root = next(n for n in nodes if n["tree"] == tree and n["node"] == 0)
        feature = int(digits(f"5:{tree}:1", 0) / 2**48 * 2)
        values = [r[1 + feature] for r in drawn]
        low, high = min(values), max(values)
        assert root["feature"] == feature and root["split"] == low + digits(f"5:{tree}:1", 12) / 2**48 * (high - low)


def test_forest_scores_match_a_plain_walk(spark):
    df = numbers(spark)
    nodes = O.iforest_fit(df, ["a", "b", "same"], trees=20, sample=64, seed=3)
    table = {(r["tree"], r["node"]): r for r in nodes.collect()}
    assert {r["feature"] for r in table.values()} <= {-1, 0, 1}
    assert max(r["sample"] for r in table.values()) == 64
    scored = O.iforest_score(df, nodes, ["a", "b", "same"]).collect()
    for row in scored[:200]:
        x, total = (row["a"], row["b"], row["same"]), 0.0
        for tree in range(20):
            node = table[tree, 0]
            while node["feature"] >= 0:
                side = "left" if x[node["feature"]] <= node["split"] else "right"
                node = table[tree, node[side]]
            total += node["path"]
        assert row["score"] == pytest.approx(2 ** (-total / 20 / O.mean_path(64)))
    assert max(scored, key=lambda r: r["score"])["row_id"] == 1001
    again = O.iforest_fit(numbers(spark, parts=7), ["a", "b", "same"], trees=20, sample=64, seed=3)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, table.values()))


def test_forest_takes_all_rows_of_a_small_table_and_a_sample_of_a_large_one(spark):
    small = O.iforest_fit(numbers(spark, 40), ["a"], trees=3)
    assert {r["sample"] for r in small.collect()} == {40}
    pooled = O.iforest_fit(numbers(spark), ["a"], trees=5, sample=32)
    assert {r["sample"] for r in pooled.collect()} == {32}


def test_forest_bears_values_that_are_not_finite(spark):
    df = spark.createDataFrame([(i, float(i)) for i in range(50)] + [(50, float("inf")), (51, float("-inf")), (52, 1e308)], "row_id long, a double")
    nodes = O.iforest_fit(df, ["a"], trees=10, sample=53)
    scores = {r["row_id"]: r["score"] for r in O.iforest_score(df, nodes, ["a"]).collect()}
    assert all(0 < s <= 1 for s in scores.values()) and scores[50] > scores[25]


def test_mean_path():
    assert [O.mean_path(n) for n in (0, 1, 2)] == [0.0, 0.0, 1.0]
    assert O.mean_path(256) == pytest.approx(10.244770920)


def test_iso_split(spark):
    df = numbers(spark).select("row_id", *[F.col(c).cast("string").alias(c) for c in ("a", "b", "same")])
    rules = [ColumnRule("a", "a", index=1, data_type="float"), ColumnRule("b", "b", index=2, data_type="int"),
             ColumnRule("same", "same", index=3, is_excluded=True, data_type="int")]
    out = iso_split(df, rules)
    gone = {r["row_id"] for r in out.outliers.collect()}
    assert 1001 in gone
    report = out.outliers.filter("row_id = 1001").first()
    assert report["numeric_values"] == '{"a":90.0,"b":-80.0}' and report["score"] > 0.7
    rows = out.table.collect()
    assert {r["row_id"] for r in rows} == set(range(1, 2001)) - gone
    n = len(rows)
    sizes = {s: sum(r["split"] == s for r in rows) for s in ("train", "validate", "test")}
    assert (sizes["train"], sizes["validate"]) == (math.floor(n * 0.7), math.floor(n * 0.15))
    with pytest.raises(ValueError):
        iso_split(df, rules[2:])


def test_a_score_at_the_threshold_stays(spark):
    scored = spark.createDataFrame([(1, 0.7), (2, np.nextafter(0.7, 1).item())], "row_id long, score double")
    assert [r["row_id"] for r in O.drop_outliers(scored).collect()] == [1]


def test_draws_of_a_forest_need_no_function_per_row_and_tree(spark):
    df = spark.range(500).selectExpr("id AS row_id", "cast(id AS double) AS x")
    plan = O.iforest_fit(df, ["x"], trees=7, sample=16)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate explode" in plan and "lambda" not in plan


def test_scores_of_uneven_trees_and_missing_numbers(spark):
    """A tree that is one long path, one that is a leaf, and values that compare with nothing."""
    chain = [(0, 2 * k, 0, float(k), 2 * k + 1, 2 * k + 2, 0.0, 64) for k in range(30)]
    chain += [(0, 2 * k + 1, -1, 0.0, -1, -1, k + 1.5, 64) for k in range(30)] + [(0, 60, -1, 0.0, -1, -1, 30.0, 64)]
    nodes = spark.createDataFrame([*chain, (1, 0, -1, 0.0, -1, -1, 3.0, 64)], O.NODE_SCHEMA)
    values = [*map(float, range(-2, 33)), float("nan"), float("inf"), None]
    df = spark.createDataFrame(list(enumerate(values)), "row_id long, x double")
    got = {r["row_id"]: r["score"] for r in O.iforest_score(df, nodes, ["x"]).collect()}
    for i, x in enumerate(values):
        first = next((k for k in range(30) if x is not None and x <= k), None)
        path = (30.0 if first is None else first + 1.5) + 3.0
        assert got[i] == pytest.approx(2.0 ** (-path / 2 / O.mean_path(64)), rel=1e-12)
