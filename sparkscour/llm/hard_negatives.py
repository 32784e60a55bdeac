"""Hard negatives by exact integer products of anchor and candidate tiles.

Anchors and rows are dealt over the cells of a grid, so that a cell holds a bounded number of both. In
a cell the scores of a tile come from Strassen's recursion on 64-bit integers: seven products of half
the size and additions, all exact, with zeros where a side is odd. Integers wrap around alike in sums and
products, so a score that fits 64 bits is right whatever the sums on the way did.

Two passes over the grid. The first keeps a heap of the best rows of the anchor's own label for each
anchor, the second a heap of the best other rows inside the window of each positive. A cell's heaps are
short lists in order; merging two lists keeps their best, so heaps of all cells merge in Spark by a rank
that cuts before and after the shuffle.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparkscour.llm.common import name
from sparkscour.session import durable

# Rows of one cell of the grid, and of one tile inside it.
CELL_ANCHORS = 2048
CELL_ROWS = 32_768
TILE_ANCHORS = 512
TILE_ROWS = 1024
# A product whose shortest side is no longer than this is done directly.
LEAF = 32
# Scores stay below this, so that a hundred times a score fits 64 bits.
LARGEST_SCORE = 1 << 56

POSITIVES = 5
NEGATIVES = 5
ANCHOR_STEP = 100
# A negative has at least this share of its positive's score, in hundredths, and at most all of it.
WINDOW = (80, 100)


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``a`` times the transpose of ``b`` in 64-bit integers, by Strassen's seven products."""
    n, m, k = len(a), len(b), a.shape[1]
    if min(n, m, k) <= LEAF:
        return np.einsum("ik,jk->ij", a, b)
    a = np.pad(a, ((0, n % 2), (0, k % 2)))
    b = np.pad(b, ((0, m % 2), (0, k % 2)))
    i, j, h = len(a) // 2, len(b) // 2, a.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :h], a[:i, h:], a[i:, :h], a[i:, h:]
    # Blocks of the second factor, named by their place in its transpose.
    b11, b21, b12, b22 = b[:j, :h], b[:j, h:], b[j:, :h], b[j:, h:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * j), dtype=np.int64)
    out[:i, :j] = p1 + p4 - p5 + p7
    out[:i, j:] = p3 + p5
    out[i:, :j] = p2 + p4
    out[i:, j:] = p1 - p2 + p3 + p6
    return out[:n, :m]


def best(owner: np.ndarray, score: np.ndarray, row: np.ndarray, most: int) -> np.ndarray:
    """Places of the ``most`` best entries of each owner, in order: higher scores, then smaller rows."""
    order = np.lexsort((row, -score, owner))
    held = owner[order]
    starts = np.flatnonzero(np.r_[True, held[1:] != held[:-1]]) if len(held) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[starts, len(held)])
    place = np.arange(len(held)) - np.repeat(starts, sizes)
    return order[place < most]


class Heaps:
    """The best entries of many owners at once; ``floor`` is the score that an owner's next one must reach."""

    def __init__(self, owners: int, most: int):
        self.most, self.floor = most, np.full(owners, np.iinfo(np.int64).min)
        self.owner = self.score = self.row = np.zeros(0, np.int64)

    def merge(self, owner: np.ndarray, score: np.ndarray, row: np.ndarray) -> None:
        owner, score, row = np.r_[self.owner, owner], np.r_[self.score, score], np.r_[self.row, row]
        kept = best(owner, score, row, self.most)
        self.owner, self.score, self.row = owner[kept], score[kept], row[kept]
        full = np.bincount(self.owner, minlength=len(self.floor)) >= self.most
        last = np.r_[self.owner[1:] != self.owner[:-1], True] if len(self.owner) else np.zeros(0, bool)
        self.floor[self.owner[last]] = np.where(full[self.owner[last]], self.score[last], self.floor[self.owner[last]])


def matrix(table: pa.Table, column: str, width: int) -> np.ndarray:
    """A list column as rows of ``width`` integers, shorter ones followed by zeros."""
    whole = table[column].combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    sizes = np.diff(whole.offsets.to_numpy())
    flat = whole.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), dtype=np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def tiles(anchors: int, rows: int) -> Iterator[tuple[slice, slice]]:
    for a in range(0, anchors, TILE_ANCHORS):
        for r in range(0, rows, TILE_ROWS):
            yield slice(a, min(a + TILE_ANCHORS, anchors)), slice(r, min(r + TILE_ROWS, rows))


def _numbers(table: pa.Table, column: str) -> np.ndarray:
    return table[column].to_numpy().astype(np.int64)


def _positives(width: int, most: int):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        label, other = _numbers(left, "label"), _numbers(right, "label")
        ids, rows = _numbers(left, "vec_id"), _numbers(right, "vec_id")
        heaps = Heaps(len(ids), most)
        a, b = matrix(left, "q", width), matrix(right, "q", width)
        # Only rows of an anchor's label can be its positives, so labels are multiplied one by one.
        for one in np.unique(label):
            mine, theirs = np.flatnonzero(label == one), np.flatnonzero(other == one)
            for x, y in tiles(len(mine), len(theirs)):
                anchors, found = mine[x], theirs[y]
                score = strassen(a[anchors], b[found])
                i, j = np.nonzero((score >= heaps.floor[anchors][:, None]) & (ids[anchors][:, None] != rows[found]))
                heaps.merge(anchors[i], score[i, j], rows[found[j]])
        return pa.table(
            {
                "a_key": _numbers(left, "a_key")[heaps.owner],
                "anchor_id": ids[heaps.owner],
                "positive_id": heaps.row,
                "positive_score": heaps.score,
            }
        )

    return cell


def _negatives(width: int, most: int, window: tuple[int, int]):
    def cell(left: pa.Table, right: pa.Table) -> pa.Table:
        label, other = _numbers(left, "label"), _numbers(right, "label")
        rows = _numbers(right, "vec_id")
        a, b = matrix(left, "q", width), matrix(right, "q", width)
        listed = left["positives"].combine_chunks()
        listed = listed.chunk(0) if isinstance(listed, pa.ChunkedArray) else listed
        sizes = np.diff(listed.offsets.to_numpy())
        flat = listed.flatten()
        place, positive, reach = (flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("place", "positive_id", "positive_score"))
        # Entry p of an anchor is owner number first[anchor] + p of the window heaps.
        first = np.cumsum(sizes) - sizes
        heaps = Heaps(len(reach), most)
        for x, y in tiles(len(label), len(rows)):
            anchors = np.arange(x.start, x.stop)
            score = strassen(a[x], b[y])
            differs = label[x][:, None] != other[y]
            for p in range(int(sizes[x].max(initial=0))):
                # Anchors with a positive at place p; windows are narrow, so few entries are left.
                some = np.flatnonzero(sizes[x] > p)
                owner = first[anchors[some]] + p
                top, s = reach[owner][:, None], score[some]
                inside = (window[1] * s <= window[1] * top) & (window[0] * top <= window[1] * s)
                i, j = np.nonzero(inside & differs[some] & (s >= heaps.floor[owner][:, None]))
                heaps.merge(owner[i], s[i, j], rows[y][j])
        whose = np.repeat(np.arange(len(label)), sizes)[heaps.owner]
        return pa.table(
            {
                "a_key": _numbers(left, "a_key")[whose],
                "place": place[heaps.owner],
                "anchor_id": _numbers(left, "vec_id")[whose],
                "positive_id": positive[heaps.owner],
                "positive_score": reach[heaps.owner],
                "negative_id": heaps.row,
                "negative_score": heaps.score,
            }
        )

    return cell


def taking_part(vectors: DataFrame, vector: str = "embedding", label: str = "label") -> DataFrame:
    """``vec_id``, ``label`` and whole components ``q`` of the rows that take part."""
    x = name(vector)
    good = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.filter(name("vec_id").isNotNull() & name(label).isNotNull() & x.isNotNull() & good)
    number, kind = name("vec_id").cast("long"), name(label).cast("long")
    moved = F.when(number % 7 == 0, (kind + 1) % 10).otherwise(kind)
    whole = F.transform(x, lambda v: F.floor(F.lit(256.0) * v.cast("double")))
    return rows.select(number.alias("vec_id"), moved.alias("label"), whole.alias("q"))


def _ranked(found: DataFrame, owner: list[str], score: str, row: str, most: int, rank: str) -> DataFrame:
    """The ``most`` best entries of each owner; Spark cuts each task's entries before the shuffle too."""
    order = Window.partitionBy(*owner).orderBy(F.desc(score), F.asc(row))
    return found.withColumn(rank, F.row_number().over(order)).filter(F.col(rank) <= most)


def mine(
    vectors: DataFrame,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    window: tuple[int, int] = WINDOW,
    cell_anchors: int = CELL_ANCHORS,
    cell_rows: int = CELL_ROWS,
) -> DataFrame:
    """Hard negatives of every anchor and positive.

    ``anchor`` is a condition on ``vec_id``; by default numbers divisible by 100. Returns ``anchor_id``,
    ``positive_id``, ``rank``, ``negative_id``, ``positive_score`` and ``negative_score``.

    Rows with a null id, label, vector or component, or one that isn't finite, take no part; an empty
    vector has score 0 with all, and shorter vectors count as followed by zeros. Rows that share an
    anchor's id are never its positives; of different content each is an anchor or a candidate of its own,
    and repeated rows are listed as often as they stand there. Ties go to the smaller id. An anchor without
    positives, or a window without rows, gives no rows, and an empty table none. Components so large that
    a hundred times a score could leave 64 bits are refused with an error.
    """
    spark = vectors.sparkSession
    rows = taking_part(vectors)
    chosen = F.col("vec_id") % ANCHOR_STEP == 0 if anchor is None else anchor
    size = F.greatest(F.abs(F.array_max("q")), F.abs(F.array_min("q")))
    n, n_anchors, width, largest = rows.agg(
        F.count(F.lit(1)), F.count_if(chosen), F.max(F.size("q")), F.max(size)
    ).first()
    width, largest = max(width or 0, 1), largest or 0
    if width * largest * largest >= LARGEST_SCORE:
        raise ValueError(f"components up to {largest} in {width} dimensions: scores may leave 64 bits")
    groups = max(1, math.ceil(n_anchors / cell_anchors))
    # Small tables are spread over the cores, but in whole tiles.
    cores = math.ceil(2 * spark.sparkContext.defaultParallelism / groups)
    parts = max(1, math.ceil(n / cell_rows), min(cores, math.ceil(n / TILE_ROWS)))

    numbered = rows.filter(chosen).withColumn("a_key", F.monotonically_increasing_id())
    anchors = durable(numbered.withColumn("g", F.pmod(F.xxhash64("a_key"), F.lit(groups)).cast("int")))
    # Rows with one id are dealt out as well: their place in the scan is part of the hash.
    dealt = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), F.lit(parts)).cast("int")
    many = rows.withColumn("h", dealt).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def grid(left: DataFrame, function, schema: str) -> DataFrame:
        spread = left.withColumn("h", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        return spread.groupBy("g", "h").cogroup(many.groupBy("g", "h")).applyInArrow(function, schema)

    schema = "a_key long, anchor_id long, positive_id long, positive_score long"
    found = grid(anchors, _positives(width, positives), schema)
    kept = durable(_ranked(found, ["a_key"], "positive_score", "positive_id", positives, "place"))
    entry = F.struct("place", "positive_id", "positive_score")
    lists = kept.groupBy("a_key").agg(F.collect_list(entry).alias("positives"))
    schema = (
        "a_key long, place long, anchor_id long, positive_id long, positive_score long, "
        "negative_id long, negative_score long"
    )
    found = grid(anchors.join(lists, "a_key"), _negatives(width, negatives, window), schema)
    ranked = _ranked(found, ["a_key", "place"], "negative_score", "negative_id", negatives, "rank")
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


REPORT_SQL = """
WITH good AS (
  SELECT CAST(vec_id AS BIGINT) AS vec_id,
         CASE WHEN vec_id % 7 = 0 THEN (CAST(label AS BIGINT) + 1) % 10 ELSE CAST(label AS BIGINT) END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS other,
         CAST(coalesce(list_sum(list_transform(generate_series(1, least(len(a.q), len(b.q))),
              lambda i: a.q[i] * b.q[i])), 0) AS BIGINT) AS score
  FROM good a JOIN good b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.other AS negative_id,
       p.positive_score, s.score AS negative_score
FROM positive p JOIN scored s ON p.anchor_id = s.anchor_id AND NOT s.same
  AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
WINDOW w AS (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other)
QUALIFY row_number() OVER w <= 5
"""
