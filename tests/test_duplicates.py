"""Similarity pairs and groups against all pairs and the sequential loop in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from sparkscour.operators import components as C
from sparkscour.operators import groups as G
from sparkscour.operators import pairs as P
from sparkscour.operators.survivors import (
    decide_survivors,
    dedupe_stats,
    invalid_decisions,
    keep_policy,
    remove_rows,
    removals_from_replies,
)
from sparkscour.plans.dedupe import dedupe, dedupe_report, removals_by_decider
from sparkscour.session import durable
from sparkscour.sources.contracts import ColumnRule


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, start=1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, start=1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def similar(a, b, strategy):
    lev = 1 - levenshtein(a, b) / max(len(a), len(b))
    x, y = set(a.split()), set(b.split())
    jac = len(x & y) / len(x | y) if x | y else 0.0
    return {"levenshtein": lev, "jaccard": jac, "combined": lev * 0.7 + jac * 0.3}[strategy]


def sequential_groups(keys, strategy, t):
    """``keys`` is row id -> key; returns member -> (leader, similarity)."""
    out, used = {}, set()
    ids = sorted(keys)
    for i in ids:
        if i in used or not keys[i]:
            continue
        found = {}
        for j in ids:
            if j > i and j not in used and keys[j]:
                s = similar(keys[i], keys[j], strategy)
                if s >= t:
                    found[j] = (i, s)
                    used.add(j)
        if found:
            out[i] = (i, 1.0)
            out |= found
        used.add(i)
    return out


def random_keys(seed, n=150, alphabet="abc", words=True):
    rng = random.Random(seed)
    keys = {}
    for i in range(1, n + 1):
        kind = rng.random()
        if kind < 0.1:
            keys[i] = ""
        elif kind < 0.45 and i > 5 and keys[rng.randint(1, i - 1)]:
            base = list(keys[rng.randint(1, i - 1)] or "ab")
            for _ in range(rng.randint(0, 3)):
                spot = rng.randrange(len(base) + 1)
                edit = rng.randint(0, 2)
                if edit == 0:
                    base.insert(spot, rng.choice(alphabet))
                elif base and spot < len(base):
                    base[spot : spot + 1] = rng.choice(alphabet) if edit == 1 else ""
            keys[i] = " ".join("".join(base).split())
        elif words:
            keys[i] = " ".join(
                "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 4)))
                for _ in range(rng.randint(1, 6))
            )
        else:
            keys[i] = "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 40)))
    return keys


def frame(spark, keys):
    return spark.createDataFrame(list(keys.items()), "row_id long, comparison_value string")


def firsts(keys):
    seen = {}
    for i in sorted(keys):
        if keys[i]:
            seen.setdefault(keys[i], i)
    return {i: k for k, i in seen.items()}


CASES = [
    *[("levenshtein", t) for t in (0.55, 0.6, 0.75, 0.85, 0.95, 1.0)],
    *[("jaccard", t) for t in (0.3, 0.6, 0.85, 1.0)],
    *[("combined", t) for t in (0.68, 0.7, 0.75, 0.85, 1.0)],
]


@pytest.mark.parametrize("strategy,t", CASES)
def test_pairs_equal_all_pairs(spark, strategy, t):
    for seed, words in ((1, True), (2, False)):
        keys = random_keys(seed, words=words)
        ids = firsts(keys)
        want = {
            (i, j, s)
            for i in ids
            for j in ids
            if i < j and (s := similar(ids[i], ids[j], strategy)) >= t
        }
        got = {tuple(r) for r in P.row_pairs(frame(spark, keys), strategy=strategy, threshold=t).collect()}
        assert got == want


@pytest.mark.parametrize("strategy,t", [("levenshtein", 0.6), ("levenshtein", 0.85), ("levenshtein", 0.95), ("combined", 0.7), ("combined", 0.85)])
def test_pairs_by_two_chunks_equal_all_pairs(spark, monkeypatch, strategy, t):
    monkeypatch.setattr(P, "LEAST_PAIRED", 0)
    # Two chunks are taken as soon as any keys can meet by them.
    monkeypatch.setattr(P, "CANDIDATE_COST", 1e9)
    for least in (1, 1000):
        monkeypatch.setattr(P, "COMMON_LEAST", least)
        keys = random_keys(3, 200, alphabet="abcdefgh", words=least == 1)
        keys |= {1000 + i: "north unit of " + k for i, k in random_keys(4, 60, "0123456789abcdef", False).items() if k}
        ids = firsts(keys)
        want = {(i, j, s) for i in ids for j in ids if i < j and (s := similar(ids[i], ids[j], strategy)) >= t}
        got = {tuple(r) for r in P.row_pairs(frame(spark, keys), strategy=strategy, threshold=t).collect()}
        assert got == want


def test_hot_postings_are_salted_without_a_change(spark, monkeypatch):
    keys = {i: f"shared prefix of all {i % 37:03d} {i}" for i in range(1, 150)}
    df = frame(spark, keys)
    want = {s: set(map(tuple, P.row_pairs(df, strategy=s, threshold=0.8).collect())) for s in P.STRATEGIES}
    monkeypatch.setattr(P, "HOT_POSTINGS", 20)
    for s in P.STRATEGIES:
        assert set(map(tuple, P.row_pairs(df, strategy=s, threshold=0.8).collect())) == want[s]
        assert len(want[s]) > 50 or s == "jaccard"


def test_low_thresholds_need_consent(spark):
    keys = random_keys(5, 40)
    with pytest.raises(ValueError, match="allow_all_pairs"):
        P.row_pairs(frame(spark, keys), threshold=0.4)
    for bad in (0, -1, 1.1):
        with pytest.raises(ValueError):
            P.row_pairs(frame(spark, keys), threshold=bad)
    ids = firsts(keys)
    for strategy, t in (("levenshtein", 0.4), ("combined", 0.3), ("combined", 0.5)):
        want = {(i, j) for i in ids for j in ids if i < j and similar(ids[i], ids[j], strategy) >= t}
        got = P.row_pairs(frame(spark, keys), strategy=strategy, threshold=t, allow_all_pairs=True)
        assert {(r["left_id"], r["right_id"]) for r in got.collect()} == want


@pytest.mark.parametrize("strategy,t,first_batch", [
    ("levenshtein", 0.85, 1000), ("levenshtein", 0.6, 10), ("jaccard", 0.5, 10), ("combined", 0.75, 25),
])
def test_groups_equal_the_sequential_loop(spark, strategy, t, first_batch):
    keys = random_keys(11, 160)
    got = G.leader_groups(frame(spark, keys), strategy, t, first_batch=first_batch)
    assert {r["row_id"]: (r["leader_id"], r["similarity"]) for r in got.collect()} == sequential_groups(
        keys, strategy, t
    )


def test_a_third_of_all_rows_in_one_group(spark, monkeypatch):
    keys = {i: "the same value" if i % 3 == 0 else f"other {i * 7919:06d} value {i * 31}" for i in range(1, 301)}
    got = G.leader_groups(frame(spark, keys), first_batch=20)
    assert {r["row_id"]: (r["leader_id"], r["similarity"]) for r in got.collect()} == sequential_groups(
        keys, "levenshtein", 0.85
    )
    df = frame(spark, keys).withColumnRenamed("comparison_value", "name")
    texts = G.group_requests(durable(got), df, max_members=10).filter("leader_id = 3").collect()
    assert len(texts) > 5
    lines = [x for r in texts for x in r["text"].split("\n")[3:-1]]
    assert sorted(lines) == sorted(f"{i},the same value" for i in range(6, 301, 3))
    assert all(r["text"].split("\n")[2] == "3,the same value" for r in texts)


@pytest.mark.parametrize("size", [4, 5, 7, 100])
def test_the_size_of_requests_does_not_change_who_stays(spark, size):
    rows = [(1, i, "leader" if i == 1 else "duplicate") for i in range(1, 31)] + [(50, 50, "leader"), (50, 51, "duplicate")]
    groups = spark.createDataFrame(rows, "leader_id long, row_id long, role string")
    df = spark.createDataFrame([(r[1], f"n{r[1]}") for r in rows], "row_id long, name string")

    def keep_last(text):
        tag, last = text.split("\n")[1], text.split("\n")[-2]
        return f"{tag}\n{last}\n{tag.replace('<', '</')}"

    removed = removals_by_decider(groups, df, keep_last, max_members=size).collect()
    assert {r["row_id"] for r in removed} == set(range(1, 30)) | {50}


@pytest.mark.parametrize("size", [4, 7, 100])
def test_the_size_of_requests_does_not_change_what_id_lists_remove(spark, size):
    rows = [(1, i, "leader" if i == 1 else "duplicate") for i in range(1, 31)] + [(50, 50, "leader"), (50, 51, "duplicate")]
    groups = spark.createDataFrame(rows, "leader_id long, row_id long, role string")
    df = spark.createDataFrame([(r[1], f"n{r[1]}") for r in rows], "row_id long, name string")

    def ids(text):
        return [int(line.split(",")[0]) for line in text.split("\n")[2:-1]]

    def all_but_last(text):
        return str(ids(text)[:-1])

    def all_odd(text):
        return str([i for i in ids(text) if i % 2])

    for decider, want in ((all_but_last, {*range(1, 30), 50}), (all_odd, {*range(1, 31, 2), 51})):
        removed = removals_by_decider(groups, df, decider, max_members=size).collect()
        assert {r["row_id"] for r in removed} == want


@pytest.mark.parametrize("size", [4, 7, 100])
def test_id_lists_remove_members_of_the_asked_group_only(spark, size):
    rows = [(1, i, "leader" if i == 1 else "duplicate") for i in range(1, 8)] + [(50, 50, "leader"), (50, 51, "duplicate")]
    groups = spark.createDataFrame(rows, "leader_id long, row_id long, role string")
    df = spark.createDataFrame([(i, f"n{i}") for i in [*range(1, 8), 50, 51, 77]], "row_id long, name string")
    for reply, want in (("[77]", set()), ("[77, 51, 3]", {3, 51}), ("[50]", {50})):
        removed = removals_by_decider(groups, df, lambda text: reply, max_members=size).collect()
        assert {r["row_id"] for r in removed} == want


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1, 0.9) for i in range(1, 30)], "left_id long, right_id long, similarity double")
    claims = {r["id"]: r["leader_id"] for r in G.claims_from_edges(durable(edges)).collect()}
    assert claims == {i: i - 1 for i in range(2, 31, 2)}


def walk_in_order(edges):
    claimed, leader = set(), {}
    for a, b, _ in sorted(edges):
        if a not in claimed:
            claimed.add(b)
            leader.setdefault(b, a)
    return leader


@pytest.mark.parametrize("task_edges", [1_000_000, 40, 5])
def test_components_are_settled_like_the_walk_in_row_order(spark, task_edges):
    rng = random.Random(9)
    edges = {(i, i + 1) for i in range(1, 60)} | {(i, i + 2) for i in range(100, 130)}
    edges |= {tuple(sorted(rng.sample(range(200, 260), 2))) for _ in range(80)} | {(300, i) for i in range(301, 350)}
    edges |= {(i, 2 * i - 340) for i in range(351, 375)}
    rows = [(a, b, 1 - (b - a) / 1000) for a, b in edges]
    df = durable(spark.createDataFrame(rows, "left_id long, right_id long, similarity double").repartition(5))
    got = G.claims_from_edges(df, task_edges=task_edges).collect()
    assert {r["id"]: r["leader_id"] for r in got} == walk_in_order(rows)
    assert all(r["similarity"] == 1 - (r["id"] - r["leader_id"]) / 1000 for r in got)


def test_a_chain_of_ten_thousand_edges_needs_few_rounds(spark, monkeypatch):
    made = []
    monkeypatch.setattr(G, "durable", lambda df: made.append(1) or durable(df))
    n = 10_000
    edges = durable(spark.range(1, n + 1).selectExpr("id AS left_id", "id + 1 AS right_id", "0.9D AS similarity"))
    got = G.claims_from_edges(edges)
    assert got.count() == n // 2 and got.filter("leader_id <> id - 1 OR id % 2 = 1").isEmpty()
    assert len(made) <= 10


def test_components_equal_a_plain_search(spark, monkeypatch):
    rng = random.Random(2)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(230)] + [(i, i + 1) for i in range(1000, 1300)]
    edges += [(2000, i) for i in range(2001, 2200)] + [(7, 7), (None, 3), (3000, 3000)]
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    want = {x: root(x) for x in list(parent)}
    df = durable(spark.createDataFrame(edges, "a long, b long").repartition(6))
    assert {r["node"]: r["component"] for r in C.components(df, "a", "b").collect()} == want
    monkeypatch.setattr(C, "CHUNK_EDGES", 7)
    monkeypatch.setattr(C, "LAST_EDGES", 5)
    assert {r["node"]: r["component"] for r in C.components(df, "a", "b").collect()} == want
    assert C.components(df.limit(0), "a", "b").count() == 0


def test_candidates_grow_no_faster_than_the_keys(spark):
    """Near copies of random texts, half of them with one long common beginning."""

    def met(n):
        rng = random.Random(n)
        keys = {}
        for i in range(0, n, 2):
            text = "".join(rng.choice("0123456789abcdef") for _ in range(22))
            start = "north unit of " if i % 4 else ""
            keys[i], keys[i + 1] = start + text, start + text[:20] + "zz"
        df = durable(frame(spark, keys).withColumnsRenamed({"row_id": "id", "comparison_value": "key"}))
        plan = P.common_items(df, "levenshtein", 0.85)
        if plan.paired is None:
            assert n < 5000
            pairs = P._chunks(df, plan.share, plan.single).join(P._grams(df, plan.share, plan.single), "gram")
        else:
            picked = P._picked(df, plan.share, plan.paired)
            assert picked.filter(~P._pairable(plan.share, plan.paired)).isEmpty()
            pairs = P._chunk_pairs(picked).join(P._gram_pairs(df, plan.share, plan.paired), "gram")
        return pairs.filter("s_id <> r_id").count()

    assert met(8000) <= 5 * met(2000)


def test_texts_of_common_words_meet_without_being_compared(spark):
    """Texts of one small vocabulary share rare words but aren't alike; near copies of short and long ones are."""
    rng = random.Random(8)
    keys = {i: " ".join(rng.sample([f"w{k}" for k in range(300)], 100)) for i in range(1, 200)}
    near = {1000 + i: keys[i] + f" more{i}" for i in range(1, 10)}
    long = [f"word{k}" for k in range(6000)]
    near |= {2000: " ".join(long), 2001: " ".join(long[300:]), 2002: " ".join(long[:-1200]), 2003: " ".join(long[::2])}
    df = frame(spark, keys | near)
    ids = firsts(keys | near)
    sets = {i: set(k.split()) for i, k in ids.items()}
    want = {(i, j, s) for i in sets for j in sets if i < j and (s := len(sets[i] & sets[j]) / len(sets[i] | sets[j])) >= 0.8}
    assert {tuple(r) for r in P.row_pairs(df, strategy="jaccard", threshold=0.8).collect()} == want and len(want) > 9
    distinct = durable(P.distinct_keys(df))
    plan = P.common_items(distinct, "jaccard", 0.8)
    found = durable(P._candidates(distinct, distinct, plan, F.col("s_id") < F.col("r_id"), "jaccard", 0.8))
    assert found.count() <= len(want) + 20
    found = P._by_numbers(found, distinct, distinct, 0.8)
    assert {tuple(sorted(r)) for r in found.collect()} >= {p[:2] for p in want}


@pytest.mark.parametrize("strategy", P.STRATEGIES)
def test_plans_do_not_hold_what_was_measured(spark, monkeypatch, strategy):
    """The driver keeps texts of all plans, so counts of 65,536 buckets mustn't be in them."""
    monkeypatch.setattr(P, "CANDIDATE_COST", 1e9)
    rng = random.Random(1)
    keys = {i: "".join(rng.choice("0123456789abcdef") for _ in range(22)) + f" unit {i % 7}" for i in range(1200)}
    plans = []

    def noted(df):
        plans.append(len(df._jdf.queryExecution().toString()))
        return durable(df)

    monkeypatch.setattr(P, "durable", noted)
    found = P.row_pairs(frame(spark, keys), strategy=strategy, threshold=0.85)
    plans.append(len(found._jdf.queryExecution().toString()))
    assert len(plans) > 2 and max(plans) < 200_000


def groups_frame(spark):
    rows = [(1, 1, "leader", 1.0, "a"), (1, 2, "duplicate", 0.9, "ab"), (5, 5, "leader", 1.0, "b"), (5, 7, "duplicate", 0.9, "b")]
    return spark.createDataFrame(rows, "leader_id long, row_id long, role string, similarity double, comparison_value string")


def test_a_decision_for_a_row_outside_keeps_the_group(spark):
    groups = groups_frame(spark)
    decisions = spark.createDataFrame([(1, 2), (5, 1), (99, 99)], "leader_id long, keep_id long")
    assert [r[0] for r in decide_survivors(groups, decisions).collect()] == [1]
    assert {tuple(r) for r in invalid_decisions(groups, decisions).collect()} == {(5, 1), (99, 99)}


def test_id_lists_count_only_without_blocks(spark):
    groups = groups_frame(spark)
    both = spark.createDataFrame([("<group_1>2,x</group_1> [5, 7]",)], "text string")
    assert {r[0] for r in removals_from_replies(groups, both).collect()} == {1}
    mixed = spark.createDataFrame([("<group_1>2,x</group_1>",), ("[7]",)], "text string")
    assert {r[0] for r in removals_from_replies(groups, mixed).collect()} == {1, 7}
    bare = spark.createDataFrame([("drop [5, 7, 0] and [1]",)], "text string")
    assert {r[0] for r in removals_from_replies(groups, bare).collect()} == {5, 7}


def test_dedupe_stops_early_with_a_reason(spark):
    df = spark.createDataFrame([(1, "alpha", "x"), (2, "beta", "")], "row_id long, name string, note string")
    rules = [ColumnRule("name", "n", index=1), ColumnRule("note", "m", index=2)]
    assert dedupe(df, rules).reason == "no unique columns"
    rules[0] = ColumnRule("name", "n", is_unique=True, index=1)
    assert dedupe(df, rules).reason == "no duplicate groups"
    more = df.union(spark.createDataFrame([(3, "ALPHA!", "full")], df.schema))
    shown = dedupe(more, rules, show_input=True)
    assert shown.reason == "requests only" and shown.table.count() == 3
    assert shown.requests.first()["text"] == "ID,name,note\n<group_1>\n1,alpha,x\n3,ALPHA!,full\n</group_1>"
    done = dedupe(more, rules, policy="most_complete")
    assert sorted(r["row_id"] for r in done.table.collect()) == [1, 2]
    report = dedupe_report(done)
    assert report["statistics"].first()["duplicates_removed"] == 1
    assert [r[0] for r in report["removed"].collect()] == [3]


def test_groups_and_survivors_send_no_table_whole(spark):
    """Keys, claims, members and requests grow with the table, however small Spark takes them for."""
    text = "concat(repeat(substring('abcdef', CAST(1 + id % 6 AS INT), 1), 8), lpad(id % 12, 4, '0'))"
    rows = durable(spark.range(60).selectExpr("id AS row_id", f"{text} AS comparison_value"))
    table = rows.withColumn("note", F.lit("x"))
    groups = durable(G.leader_groups(rows))
    kept = keep_policy(groups, "most_complete", table)
    removed = durable(decide_survivors(groups, kept))
    for name, out in {
        "pairs": P.row_pairs(rows), "combined": P.row_pairs(rows, strategy="combined", threshold=0.8),
        "words": P.row_pairs(rows, strategy="jaccard"), "groups": G.leader_groups(rows), "kept": kept,
        "requests": G.group_requests(groups, table), "survivors": decide_survivors(groups, kept),
        "invalid": invalid_decisions(groups, kept), "removed": remove_rows(table, removed),
        "stats": dedupe_stats(table, groups, removed),
    }.items():
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan, name


def test_no_pair_of_texts_takes_a_set_along(spark, monkeypatch):
    """A cluster's sets go to tasks by parts of it: far fewer copies than pairs, and the same pairs."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(80)]
    base = [rng.sample(words, 30) for _ in range(3)]
    keys = {}
    for i in range(1, 121):
        changed = list(base[i % 3])
        changed[rng.randrange(30)] = rng.choice(words)
        keys[i] = " ".join(changed)
    kept = {i: set(k.split()) for i, k in firsts(keys).items()}
    want = {}
    for a in kept:
        for b in kept:
            score = len(kept[a] & kept[b]) / len(kept[a] | kept[b])
            if a < b and score >= 0.85:
                want[a, b] = score
    assert len(want) > 10 * len(kept)
    sent = []
    joined = P.join_hot

    def seen(many, one, on, *rest, **more):
        if "held_by" in many.columns:
            sent.append(many.count())
        return joined(many, one, on, *rest, **more)

    monkeypatch.setattr(P, "join_hot", seen)
    for size, copies in ((2048, 1), (8, 12)):
        sent.clear()
        monkeypatch.setattr(P, "TILE_KEYS", size)
        monkeypatch.setattr(P, "PAIRS_AT_ONCE", size)
        got = P.row_pairs(frame(spark, keys), strategy="jaccard")
        assert {(r[0], r[1]): r[2] for r in got.collect()} == want
        assert len(sent) == 2 and all(n <= copies * len(kept) for n in sent)
