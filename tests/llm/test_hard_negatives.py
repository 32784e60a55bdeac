"""Hard negatives against plain loops, and Strassen's products against plain ones."""

import math
import random

import numpy as np
import pytest

from sparkscour.llm import hard_negatives
from sparkscour.llm.hard_negatives import Heaps, mine, strassen

SCHEMA = "vec_id long, embedding array<double>, label int, q string, h string, `a.b` int, rank int"


def plain(rows, step=100, positives=5, negatives=5):
    good = []
    for vec_id, vector, label in rows:
        if vec_id is None or label is None or vector is None:
            continue
        if any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id % 7 == 0 else label
        good.append((vec_id, [math.floor(256 * x) for x in vector], label))
    out = []
    for a, u, kind in good:
        if a % step:
            continue
        scored = sorted((-sum(x * y for x, y in zip(u, v)), b, k) for b, v, k in good if b != a)
        for top, p, _ in [s for s in scored if s[2] == kind][:positives]:
            inside = [s for s in scored if s[2] != kind and 80 * -top <= 100 * -s[0] <= 100 * -top]
            for rank, (score, b, _) in enumerate(inside[:negatives], 1):
                out.append((a, p, rank, b, -top, -score))
    return sorted(out)


def run(spark, rows, **options):
    df = spark.createDataFrame([(*r, "q", "h", 1, 2) for r in rows], SCHEMA)
    return sorted(map(tuple, mine(df, **options).collect()))


def vectors(seed, n, width=6, labels=3, scale=0.05):
    rng = random.Random(seed)
    return [(i, [round(rng.choice([-1, 0, 1, 2]) * scale, 4) for _ in range(width)], rng.randrange(labels)) for i in range(n)]


@pytest.mark.parametrize("n,k,m", [(1, 1, 1), (33, 65, 70), (64, 64, 64), (100, 37, 131), (257, 70, 129)])
def test_strassen(n, k, m):
    rng = np.random.default_rng(n)
    a, b = rng.integers(-(1 << 20), 1 << 20, (n, k)), rng.integers(-(1 << 20), 1 << 20, (m, k))
    assert (strassen(a, b) == a @ b.T).all()


def test_strassen_wraps_around_exactly():
    a, b = np.full((64, 64), 1 << 27), np.full((64, 64), -(1 << 27))
    assert (strassen(a, b) == -(1 << 60)).all()


def test_heaps_merge_in_any_order():
    rng = np.random.default_rng(3)
    owner, score, row = rng.integers(0, 9, 500), rng.integers(-5, 5, 500), rng.permutation(500)
    want = {o: sorted((-s, r) for p, s, r in zip(owner, score, row) if p == o)[:4] for o in range(9)}
    heaps = Heaps(9, 4)
    for part in np.array_split(rng.permutation(500), 7):
        heaps.merge(owner[part], score[part], row[part])
    got = {o: [(-s, r) for p, s, r in zip(heaps.owner, heaps.score, heaps.row) if p == o] for o in range(9)}
    assert got == want
    assert all(heaps.floor[o] == -want[o][-1][0] for o in range(9))


def test_ties_labels_and_windows(spark):
    rows = vectors(1, 900)  # few values: scores tie often
    assert run(spark, rows) == plain(rows) != []


def test_cells_of_a_grid_give_the_same(spark, monkeypatch):
    rows = vectors(2, 1500, width=40, labels=12, scale=0.3)
    want = plain(rows)
    assert run(spark, rows, cell_anchors=3, cell_rows=200) == want
    monkeypatch.setattr(hard_negatives, "TILE_ROWS", 64)
    assert run(spark, rows) == want


def test_one_label_holds_a_third(spark):
    rows = [(i, v, 0 if i % 3 == 0 else k) for i, v, k in vectors(5, 1200, labels=10)]
    assert run(spark, rows, cell_rows=100) == plain(rows)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [
        (0, [0.5, 0.5], 9), (100, [0.5, 0.5], 0), (200, [0.25], 0), (300, [], 1), (400, None, 1), (None, [0.5, 0.5], 1),
        (500, [0.5, None], 1), (600, [nan, 0.1], 1), (1, [inf, 0.1], 0), (2, [-inf], 0), (3, [0.5, 0.5], None),
        (4, [0.5, 0.5], 0), (5, [0.5, 0.25], 0), (6, [-0.5, -0.5], 0), (7, [0.5, 0.5], 9), (8, [0.45, 0.45], 1),
        (9, [0.45, 0.45], 1), (10, [0.4, 0.4], 2), (11, [0.399, 0.4], 2), (12, [0.0, 0.0], 3), (13, [0.5, 0.5, 0.0], 2),
        (-100, [0.5, -0.5], 4), (-7, [0.5, -0.5], 4), (14, [0.5, 0.5], -3),
    ]
    want = plain(rows)
    assert run(spark, rows) == want != []
    twice = rows + [(8, [0.45, 0.45], 1)] * 2 + [(100, [0.5, 0.5], 0)]
    assert run(spark, twice) == plain(twice)
    assert run(spark, []) == []
    assert run(spark, [(1, [0.1], 1)]) == []


def test_components_that_leave_64_bits_are_refused(spark):
    with pytest.raises(ValueError, match="64 bits"):
        run(spark, [(100, [1e30], 1), (1, [0.5], 1)])
