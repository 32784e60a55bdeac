"""Isolation forest (Liu, Ting and Zhou, 2008): trees of small samples, then scores per row.

The fit touches a bounded sample however large the table is; scoring is one map-side pass with
the node table (at most trees x (2 x sample - 1) rows) on every executor.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.functions.text import as_col
from sparkscour.functions.validity import leading_number

# Defaults of the forest and the score above which a row is an outlier.
TREES = 100
SAMPLE = 256
OUTLIER_SCORE = 0.7
# Bits of a draw: twelve hexadecimal digits of an md5.
DRAW_BITS = 48
# Values beyond this count as this, so that splits stay finite.
LARGEST = 1e300
# Rows that are scored together; what they need stays in a core's cache.
SCORED_ROWS = 10_000

NODE_SCHEMA = (
    "tree int, node int, feature int, split double, left int, right int, path double, sample int"
)
EULER_GAMMA = 0.5772156649015329


def mean_path(n: int) -> float:
    """Mean depth of an unsuccessful search in a binary search tree of ``n`` keys."""
    if n <= 1:
        return 0.0
    if n == 2:
        return 1.0
    return 2.0 * (np.log(n - 1.0) + EULER_GAMMA) - 2.0 * (n - 1.0) / n


def iforest_fit(
    df: DataFrame,
    columns: Sequence[str],
    trees: int = TREES,
    sample: int = SAMPLE,
    seed: int = 42,
    row_id: str = "row_id",
) -> DataFrame:
    """The node table of the forest. The same rows and seed always give the same trees.

    Every random choice comes from an md5, so that any engine can draw the same forest. A row has two
    numbers from the md5 of seed and id, and tree ``t`` draws by ``first + t * second``, cut to 48 bits:
    each tree takes the ``sample`` rows with the smallest draws. In one scan a row is listed only for the
    trees in which it is under a bound that about twice the rows needed stay under; each task keeps its
    smallest draws of a tree, and those of all tasks are merged. A node takes its feature and its split
    from the md5 of seed, tree and place (1 for the root, 2p and 2p + 1 below p).
    """
    columns = list(columns)
    if not columns:
        raise ValueError("an isolation forest needs at least one numeric column")
    values = df.select(
        as_col(row_id).alias("row_id"), *[as_col(c).cast("double").alias(c) for c in columns]
    )
    n = df.count()
    cut = int(min(1.0, (2.0 * sample + 50) / max(n, 1)) * (1 << DRAW_BITS))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col("row_id").cast("string")))

    def number(first: int) -> Column:
        return F.conv(F.substring(digest, first, DRAW_BITS // 4), 16, 10).cast("long")

    def draw(tree: Column) -> Column:
        return (F.col("_first") + tree * F.col("_second")).bitwiseAND(F.lit((1 << DRAW_BITS) - 1))

    # Every row meets every tree, so draws are compared as rows of a loop, not by a function on arrays.
    each = F.explode(F.sequence(F.lit(0), F.lit(trees - 1)))
    numbered = values.withColumns({"_first": number(1), "_second": number(1 + DRAW_BITS // 4)})
    drawn = numbered.withColumn("tree", each).withColumn("_draw", draw(F.col("tree"))).filter(F.col("_draw") < cut)
    # Spark applies the limit of the rank in each task before the shuffle, then to what is left.
    order = Window.partitionBy("tree").orderBy("_draw", "row_id")
    picked = drawn.withColumn("_rank", F.row_number().over(order)).filter(F.col("_rank") <= sample)

    leaf_paths = [mean_path(k) for k in range(sample + 1)]
    names = [f.split()[0] for f in NODE_SCHEMA.split(", ")]

    def grow(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(key[0])
        data = pdf.sort_values("_rank")[columns].to_numpy(dtype=float).clip(-LARGEST, LARGEST)
        limit = int(np.ceil(np.log2(max(len(data), 2))))

        def chances(place: int) -> tuple[float, float]:
            digits, width = hashlib.md5(f"{seed}:{tree}:{place}".encode()).hexdigest(), DRAW_BITS // 4
            return tuple(int(digits[k : k + width], 16) / (1 << DRAW_BITS) for k in (0, width))

        nodes: list[list] = []
        todo = [(np.arange(len(data)), 0, -1, 0, 1)]
        while todo:
            rows, depth, parent, side, place = todo.pop()
            node = len(nodes)
            if parent >= 0:
                nodes[parent][4 + side] = node
            part = data[rows]
            low, high = part.min(axis=0), part.max(axis=0)
            varying = np.flatnonzero(high > low)
            if depth >= limit or len(rows) <= 1 or len(varying) == 0:
                # A leaf counts the depth its rows would still need.
                nodes.append([tree, node, -1, 0.0, -1, -1, depth + leaf_paths[len(rows)], len(data)])
                continue
            first, second = chances(place)
            feature = int(varying[int(first * len(varying))])
            split = float(low[feature] + second * (high[feature] - low[feature]))
            if split >= high[feature]:  # rounded up: nothing would go right
                split = float(low[feature])
            goes_left = part[:, feature] <= split
            nodes.append([tree, node, feature, split, -1, -1, 0.0, len(data)])
            todo.append((rows[~goes_left], depth + 1, node, 1, 2 * place + 1))
            todo.append((rows[goes_left], depth + 1, node, 0, 2 * place))
        return pd.DataFrame(nodes, columns=names)

    return picked.groupBy("tree").applyInPandas(grow, NODE_SCHEMA)


def _levels(starts: np.ndarray, inner: np.ndarray, child: np.ndarray) -> list[int]:
    """How many steps lead from each root to its deepest leaf."""
    out = []
    for root in starts:
        at, n = np.array([root]), 0
        while (at := at[inner[at]]).size:
            at, n = np.concatenate([child[2 * at], child[2 * at + 1]]), n + 1
        out.append(n)
    return out


def iforest_score(
    df: DataFrame,
    nodes: DataFrame,
    columns: Sequence[str],
    row_id: str = "row_id",
    values: Sequence[Column] | None = None,
    into: str = "score",
) -> DataFrame:
    """``df`` with a score in (0, 1]; higher is more isolated.

    ``values`` are the numbers to score if they aren't the columns themselves.
    """
    columns = list(columns)
    values = [as_col(c) for c in columns] if values is None else list(values)
    # At most 100 x 511 nodes with the defaults, so the table fits the driver and a task.
    table = nodes.toPandas().sort_values(["tree", "node"], ignore_index=True)
    starts = table.groupby("tree").cumcount().eq(0).to_numpy().nonzero()[0]
    base = np.repeat(starts, np.diff(np.append(starts, len(table))))
    inner = table["feature"].to_numpy() >= 0
    own = np.arange(len(table))
    # A leaf is its own child, so that all rows take the same steps.
    feature = np.where(inner, table["feature"].to_numpy(), 0).astype(np.intp)
    split = table["split"].to_numpy(float)
    left, right = (np.where(inner, table[side].to_numpy() + base, own) for side in ("left", "right"))
    child = np.stack([right, left], axis=1).ravel().astype(np.intp)
    path = table["path"].to_numpy(float)
    norm = max(mean_path(int(table["sample"].max())), 1e-12) if len(table) else 1.0
    steps = _levels(starts, inner, child)
    forest = df.sparkSession.sparkContext.broadcast((starts.astype(np.intp), steps, feature, split, child, path, norm))
    rows_at_once = SCORED_ROWS

    @F.pandas_udf("double")
    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        roots, levels, feat, cut, after, depth, scale = forest.value
        for pdf in parts:
            x = pdf.to_numpy(dtype=float)
            total = np.zeros(len(x))
            for low in range(0, len(x), rows_at_once):
                part = x[low : low + rows_at_once]
                n = len(part)
                flat, cells = part.ravel(), np.arange(n) * part.shape[1]
                at, here, goes_left = np.empty(n, np.intp), np.empty(n, np.intp), np.empty(n, bool)
                value, bound, summed = np.empty(n), np.empty(n), total[low : low + n]
                # Places are always inside the arrays; "clip" spares a copy.
                for root, level in zip(roots, levels):
                    at.fill(root)
                    for _ in range(level):
                        np.take(feat, at, out=here, mode="clip")
                        np.add(here, cells, out=here)
                        np.take(flat, here, out=value, mode="clip")
                        np.take(cut, at, out=bound, mode="clip")
                        np.less_equal(value, bound, out=goes_left)
                        np.add(at, at, out=at)
                        np.add(at, goes_left, out=here)
                        np.take(after, here, out=at, mode="clip")
                    summed += np.take(depth, at, out=value, mode="clip")
            yield pd.Series(np.power(2.0, -total / max(len(roots), 1) / scale))

    features = F.struct(*[v.cast("double").alias(c) for v, c in zip(values, columns)])
    return df.withColumn(into, score(features))


def drop_outliers(scored: DataFrame, threshold: float = OUTLIER_SCORE) -> DataFrame:
    """Keep the rows that do not score above the threshold."""
    return scored.filter(~(F.col("score") > threshold)).drop("score")


def outlier_report(
    scored: DataFrame,
    columns: Sequence[str],
    threshold: float = OUTLIER_SCORE,
    row_id: str = "row_id",
) -> DataFrame:
    """Id, score with three decimals and the numeric values of each outlier."""
    return scored.filter(F.col("score") > threshold).select(
        row_id,
        F.round("score", 3).alias("score"),
        F.to_json(F.struct(*[as_col(c) for c in columns])).alias("numeric_values"),
    )


def numeric_features(df: DataFrame, columns: Sequence[str], row_id: str = "row_id") -> DataFrame:
    """Only the id and the coerced numeric columns."""
    return df.select(row_id, *[leading_number(c).alias(c) for c in columns])
