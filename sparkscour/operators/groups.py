"""Duplicate groups: the first row of a group leads it and claims what is similar to it.

In row order, a row that no earlier leader claimed is a leader, and it claims every later
unclaimed row that is similar to it. So a row leads iff none of its smaller neighbours leads, and
a claimed row belongs to its smallest neighbouring leader. A few rounds over the edges settle most
rows. What is left is cut into connected components: those that fit a task are settled there in row
order, whole components at a time, and only larger ones go on in rounds. On large inputs keys come in
batches of growing size, so that rows an earlier leader has claimed are never paired with each other.
"""

from __future__ import annotations

import logging

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import csv_line, csv_quote
from sparkscour.operators.components import components
from sparkscour.operators.pairs import (
    common_items,
    distinct_keys,
    known_strategy,
    require_threshold,
    similarity_pairs,
    similarity_pairs_between,
)
from sparkscour.operators.rows import distributed_rank
from sparkscour.session import durable, join_hot, unsent

log = logging.getLogger(__name__)

# Distinct keys whose pairs are all formed in the first batch; later batches grow.
FIRST_BATCH = 200_000
BATCH_GROWTH = 4
MANY_ROUNDS = 25
# Rounds over all edges before components are looked for, and edges that a task may settle in row order.
FIRST_ROUNDS = 3
TASK_EDGES = 500_000
# Members that go into one request text; larger groups are decided in rounds (plans.dedupe).
REQUEST_MEMBERS = 1000


def _in_order_of_pack(table: pa.Table) -> pa.Table:
    """The claimed nodes of whole components, by walking their edges in row order."""
    left, right = table["left_id"].to_numpy(), table["right_id"].to_numpy()
    order = np.lexsort((right, left))
    claimed: set[int] = set()
    for a, b in zip(left[order].tolist(), right[order].tolist()):
        if a not in claimed:
            claimed.add(b)
    return pa.table({"id": pa.array(sorted(claimed), pa.int64())})


def _settled_by_component(edges: DataFrame, task_edges: int) -> tuple[DataFrame, DataFrame | None]:
    """Claimed nodes of the components that fit a task, and the edges of the others (None: all fit)."""
    n = edges.count()
    if n <= task_edges:
        # All components together fit, so it doesn't matter where one ends.
        whole = edges.withColumn("_pack", F.lit(0)).groupBy("_pack")
        return durable(whole.applyInArrow(_in_order_of_pack, "id long")), None
    named = durable(components(edges, "left_id", "right_id"))
    placed = join_hot(edges, named.withColumnRenamed("node", "left_id"), "left_id", spread_by=F.col("right_id"))
    placed = durable(placed.select("left_id", "right_id", "component"))
    sizes = durable(placed.groupBy("component").agg(F.count(F.lit(1)).alias("_edges")))
    large = sizes.filter(F.col("_edges") > task_edges).select("component")
    fits = join_hot(placed, large, "component", "left_anti", spread_by=F.col("right_id"), measured=sizes, weight="_edges")
    # Small components share a task: so many parts that each holds about half of what fits.
    pack = F.pmod(F.xxhash64("component"), F.lit(max(1, 2 * n // task_edges)))
    claimed = fits.select("left_id", "right_id", pack.alias("_pack")).groupBy("_pack").applyInArrow(_in_order_of_pack, "id long")
    rest = join_hot(placed, large, "component", "left_semi", spread_by=F.col("right_id"), measured=sizes, weight="_edges")
    return durable(claimed), durable(rest.select("left_id", "right_id"))


def claims_from_edges(edges: DataFrame, task_edges: int = TASK_EDGES) -> DataFrame:
    """``(id, leader_id, similarity)`` of each claimed node of ``(left_id, right_id, similarity)``.

    A round takes the nodes without an open smaller neighbour as leaders, claims their
    neighbours and drops the edges of these. After ``FIRST_ROUNDS``, components of at most
    ``task_edges`` edges are settled in one pass, exactly as the walk in row order does it; the rounds
    go on for larger ones. Each round settles at least the smallest open node, so the loop always ends.
    """
    open_edges = edges.select("left_id", "right_id")
    claimed = None
    rounds = 0
    while not open_edges.isEmpty():
        rounds += 1
        if rounds == MANY_ROUNDS:
            log.warning("more than %d rounds of leader election", MANY_ROUNDS)
        if rounds == FIRST_ROUNDS + 1:
            taken, open_edges = _settled_by_component(open_edges, task_edges)
            claimed = taken if claimed is None else claimed.union(taken)
            if open_edges is None:
                break
            continue
        below = open_edges.select(F.col("left_id").alias("id"), F.lit(0).alias("below")).union(
            open_edges.select("right_id", F.lit(1))
        )
        first = below.groupBy("id").agg(F.max("below").alias("below")).filter("below = 0")
        taken = durable(
            join_hot(
                open_edges, first.select(F.col("id").alias("left_id")), "left_id",
                spread_by=F.col("right_id"),
            )
            .select(F.col("right_id").alias("id"))
            .distinct()
        )
        claimed = taken if claimed is None else claimed.union(taken)
        rest = join_hot(
            open_edges, taken.withColumnRenamed("id", "right_id"), "right_id", "left_anti",
            spread_by=F.col("left_id"),
        )
        rest = join_hot(
            rest, taken.withColumnRenamed("id", "left_id"), "left_id", "left_anti",
            spread_by=F.col("right_id"), measured=open_edges,
        )
        open_edges = durable(rest.select("left_id", "right_id"))
    if claimed is None:
        return edges.select(
            F.col("right_id").alias("id"), F.col("left_id").alias("leader_id"), "similarity"
        )
    leading = join_hot(
        edges, claimed.withColumnRenamed("id", "left_id"), "left_id", "left_anti",
        spread_by=F.col("right_id"),
    )
    return leading.groupBy(F.col("right_id").alias("id")).agg(
        F.min("left_id").alias("leader_id"),
        F.min_by("similarity", "left_id").alias("similarity"),
    )


def _batch_ends(keys: DataFrame, first_batch: int) -> list[int]:
    """Last ids of the batches, at real ranks of the ids; the last batch has no end."""
    n, ranks, done = keys.count(), [], first_batch
    while done < n:
        ranks.append(done)
        done += first_batch * BATCH_GROWTH ** len(ranks)
    if not ranks:
        return []
    ranked = distributed_rank(keys.select("id"), ["id"], rank_col="_rank")
    return sorted(r["id"] for r in ranked.filter(F.col("_rank").isin(*ranks)).collect())


def key_claims(
    keys: DataFrame,
    strategy: str = "levenshtein",
    threshold: float | None = None,
    allow_all_pairs: bool = False,
    first_batch: int = FIRST_BATCH,
) -> DataFrame:
    """Claims among distinct keys ``(id, key)``, without forming the pairs of claimed keys."""
    t = require_threshold(threshold)
    strategy = known_strategy(strategy)
    common = common_items(keys, strategy, t)
    ends = _batch_ends(keys, first_batch)
    waiting, settled = keys.select("id", "key"), None
    for end in [*ends, None]:
        batch = waiting if end is None else waiting.filter(F.col("id") <= end)
        edges = durable(similarity_pairs(batch, strategy, t, allow_all_pairs, common))
        claims = claims_from_edges(edges)
        if end is not None:
            claims = durable(claims)
            leaders = batch.join(unsent(claims.select("id")), "id", "left_anti")
            later = waiting.filter(F.col("id") > end)
            reach = similarity_pairs_between(leaders, later, strategy, t, common, allow_all_pairs)
            caught = durable(
                reach.groupBy(F.col("b_id").alias("id")).agg(
                    F.min("a_id").alias("leader_id"),
                    F.min_by("similarity", "a_id").alias("similarity"),
                )
            )
            waiting = durable(later.join(unsent(caught.select("id")), "id", "left_anti"))
            claims = claims.unionByName(caught)
        settled = claims if settled is None else settled.unionByName(claims)
    return settled


def leader_groups(
    rows: DataFrame,
    strategy: str = "levenshtein",
    threshold: float | None = None,
    key: str = "comparison_value",
    row_id: str = "row_id",
    allow_all_pairs: bool = False,
    first_batch: int = FIRST_BATCH,
) -> DataFrame:
    """One row per member of each group with at least one duplicate.

    Columns: ``leader_id``, ``row_id``, ``role`` (leader or duplicate), ``similarity`` to the
    leader, ``comparison_value``. Rows with an empty key take no part. Rows with equal keys
    follow the first of them.
    """
    keyed = rows.select(F.col(row_id).alias("row_id"), F.col(key).alias("key"))
    keys = durable(distinct_keys(keyed, "key", "row_id"))
    claims = durable(key_claims(keys, strategy, threshold, allow_all_pairs, first_batch))
    leaders = claims.select(F.col("leader_id").alias("id"), F.lit(True).alias("_leads")).distinct()
    grouped = (
        keys.join(unsent(claims), "id", "left")
        .join(unsent(leaders), "id", "left")
        .filter(F.col("leader_id").isNotNull() | F.col("_leads") | (F.col("copies") > 1))
        .select(
            "key",
            F.coalesce("leader_id", "id").alias("leader_id"),
            F.coalesce("similarity", F.lit(1.0)).alias("similarity"),
        )
    )
    return join_hot(
        keyed, grouped, "key", spread_by=F.col("row_id"), measured=keys, weight="copies"
    ).select(
        "leader_id",
        "row_id",
        F.when(F.col("row_id") == F.col("leader_id"), "leader")
        .otherwise("duplicate")
        .alias("role"),
        "similarity",
        F.col("key").alias("comparison_value"),
    )


def group_members(groups: DataFrame) -> DataFrame:
    """Member listing with the similarity as a percentage; one row per member."""
    return groups.select(
        "leader_id",
        "row_id",
        "role",
        F.round(F.col("similarity") * 100, 2).alias("similarity_pct"),
        "comparison_value",
    )


def group_sizes(groups: DataFrame) -> DataFrame:
    """Members and lowest and highest similarity of each group."""
    duplicate = F.when(F.col("role") == "duplicate", F.col("similarity"))
    return groups.groupBy("leader_id").agg(
        F.count(F.lit(1)).alias("members"),
        F.round(F.min(duplicate) * 100, 2).alias("lowest_pct"),
        F.round(F.max(duplicate) * 100, 2).alias("highest_pct"),
    )


def part_of(duplicates: Column, max_members: int) -> Column:
    """The request of its group (of so many duplicates) that a duplicate (``row_id``) is dealt to, from 1."""
    parts = F.when(duplicates > max_members, F.ceil(duplicates * 2 / max_members)).otherwise(F.lit(1))
    return F.pmod(F.xxhash64("row_id"), parts.cast("long")) + 1


def group_requests(
    groups: DataFrame,
    df: DataFrame,
    columns: list[str] | None = None,
    row_id: str = "row_id",
    max_members: int = REQUEST_MEMBERS,
) -> DataFrame:
    """Text blocks that ask for a decision: header line, leader line, then the duplicates.

    One row per group; a group above ``max_members`` duplicates is dealt out by hash to several
    parts, each with the leader line, so no text grows with the group.
    """
    columns = columns or [c for c in df.columns if c != row_id]
    header = F.concat_ws(",", F.lit("ID"), *[csv_quote(F.lit(c)) for c in columns])
    lines = df.select(F.col(row_id).alias("row_id"), csv_line(row_id, *columns).alias("_line"))
    listed = groups.select("leader_id", "row_id").join(unsent(lines), "row_id")
    leads = F.col("row_id") == F.col("leader_id")
    sizes = listed.groupBy("leader_id").agg(
        F.count_if(~leads).alias("_duplicates"),
        F.max(F.when(leads, F.col("_line"))).alias("_leader_line"),
    )
    dealt = join_hot(
        listed.filter(~leads), sizes, "leader_id", spread_by=F.col("row_id"), measured=groups
    ).withColumn("part", part_of(F.col("_duplicates"), max_members))
    duplicates = F.transform(
        F.sort_array(F.collect_list(F.struct("row_id", "_line"))), lambda m: m["_line"]
    )
    texts = dealt.groupBy("leader_id", "part").agg(
        F.first("_leader_line").alias("_leader_line"), duplicates.alias("_lines")
    )
    return texts.select(
        "leader_id",
        "part",
        F.concat_ws(
            "\n",
            header,
            F.concat(F.lit("<group_"), F.col("leader_id"), F.lit(">")),
            F.col("_leader_line"),
            F.array_join("_lines", "\n"),
            F.concat(F.lit("</group_"), F.col("leader_id"), F.lit(">")),
        ).alias("text"),
    )
