"""Pivotal mixing and line removal against plain Python."""

import hashlib
import random
from collections import Counter, defaultdict

from sparkscour.llm import line_spread, pivotal
from tests.llm.cases import awkward, document, frame, words


def plain_targets(sizes):
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in capped)
        open_ = [s for s in order if s not in capped]
        level = rest / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return {s: float(3 * sizes[s]) if s in capped else weight[s] * level for s in order}
        capped |= over


def mixed_rows(seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        source = rnd.choice(["a", "a", "a", "b", "c", "d", None])
        rows.append(document(i, " ".join("w" for _ in range(rnd.choice([0, 1, 3, 10, 40]))), source=source))
    return rows + [document(7, "w w w", source="tiny")]


def test_targets_and_taken_words(spark):
    rows = mixed_rows(1)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    want = plain_targets(sizes)
    got = pivotal.mix_report(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    taken = Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and abs(r["target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 3 * r["size"] and r["taken"] == r["copies"] * r["size"]
        taken[r["source"]] += r["taken"]
    assert all(abs(taken[s] - want[s]) <= 40 for s in want)
    assert abs(want["tiny"] - 9) < 1e-6 and taken["tiny"] == 9


def test_reruns_agree_whatever_the_partitions(spark):
    df = frame(spark, mixed_rows(2, 300))
    one = sorted(map(tuple, pivotal.mix_report(df.repartition(1)).collect()), key=str)
    many = sorted(map(tuple, pivotal.mix_report(df.repartition(13, "n_chars")).collect()), key=str)
    assert one == many


def test_expectation_of_copies_is_kept(spark):
    rows = [document(i, "w " * (1 + i % 5), source="a" if i % 2 else "b") for i in range(60)]
    total = Counter()
    for seed in range(12):
        for r in pivotal.mix_report(frame(spark, rows), seed=seed).collect():
            total[r["source"]] += r["copies"] / (r["target"] / r["source_size"]) / 12 / 30
    assert all(0.9 < x < 1.1 for x in total.values())


def test_awkward_documents_are_mixed_as_planned(spark):
    df = frame(spark)
    report = pivotal.mix_report(df).collect()
    assert len(report) == len(awkward())
    rows = pivotal.mix(df)
    assert rows.columns == df.columns
    got = Counter((r["doc_id"], r["source"], len(words(r["text"]))) for r in rows.collect())
    want = Counter()
    for r in report:
        want[r["doc_id"], r["source"], r["size"]] += r["copies"]
    assert got == +want


def test_many_equal_rows_share_their_copies(spark):
    rows = [document(1, "a b c", source="a")] * 50 + [document(2, "a b c d", source="b")] * 3
    report = pivotal.mix_report(frame(spark, rows)).collect()
    copies = [r["copies"] for r in report if r["doc_id"] == 1]
    assert len(report) == 53 and max(copies) - min(copies) <= 1
    assert pivotal.mix(frame(spark, rows)).count() == sum(r["copies"] for r in report)


def test_empty_tables(spark):
    df = frame(spark, [])
    assert pivotal.mix_report(df).count() == 0 and pivotal.mix(df).count() == 0
    assert line_spread.report(df).count() == 0 and line_spread.dedup_lines(df).count() == 0


def plain_lines(rows, least):
    sites, first = defaultdict(set), {}
    keyed = [((r[0] is None, r[0] or 0), r) for r in rows]
    for key, r in keyed:
        for i, line in enumerate((r[1] or "").split("\n")):
            bare = line.strip(" \t\r\x0b\x0c")
            if bare:
                if r[3] is not None:
                    sites[bare].add(r[3])
                first[bare] = min(first.get(bare, (key, i)), (key, i))
    out = []
    for key, r in keyed:
        kept = [
            line
            for i, line in enumerate((r[1] or "").split("\n"))
            if len(sites[line.strip(" \t\r\x0b\x0c")]) < least or first.get(line.strip(" \t\r\x0b\x0c")) == (key, i)
        ]
        n = len((r[1] or "").split("\n"))
        out.append((r[0], n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_lines_against_a_plain_loop(spark):
    rnd = random.Random(4)
    rows = []
    for i in range(150):
        lines = [f" common {rnd.randrange(12)}\r" if rnd.random() < 0.5 else f"own {i} {k}" for k in range(rnd.randrange(6))]
        lines += [""] * rnd.randrange(2) + ["on few sites"] * (i % 40 == 0)
        rows.append(document(i, "\n".join(lines), source=rnd.choice([f"s{k}" for k in range(12)] + [None])))
    for least in (2, 5, 10, 12, 13):
        got = sorted((tuple(r) for r in line_spread.report(frame(spark, rows), least).collect()), key=str)
        assert got == plain_lines(rows, least), least


def test_awkward_documents_and_removed_lines(spark):
    rows = awkward() + [document(100 + i, "boiler plate\n" + ("own line" if i < 3 else "") + "\n", source=f"s{i}") for i in range(12)]
    got = sorted((tuple(r) for r in line_spread.report(frame(spark, rows)).collect()), key=str)
    assert got == plain_lines(rows, 10)
    kept = line_spread.dedup_lines(frame(spark, rows))
    assert kept.columns == frame(spark).columns
    texts = {r["doc_id"]: r for r in kept.collect()}
    # The first keeps the line, others keep what is theirs, and those of nothing else go.
    assert texts[100]["text"].startswith("boiler") and texts[101]["text"] == "own line\n" and 105 not in texts
    assert texts[101]["n_chars"] == 9 and texts[1]["text"] is None and texts[2]["text"] == ""
