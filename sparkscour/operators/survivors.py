"""Which row of a duplicate group stays, and the counts of what was removed."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col
from sparkscour.functions.validity import is_empty, percent
from sparkscour.operators.reply_text import parse_decisions, parse_removal_list
from sparkscour.session import durable, join_hot, unsent


def _best(groups: DataFrame, rank: Column) -> DataFrame:
    best = F.min_by("row_id", F.struct(rank, F.col("row_id")))
    return groups.groupBy("leader_id").agg(best.alias("keep_id"))


def keep_leader(groups: DataFrame) -> DataFrame:
    return groups.select("leader_id", F.col("leader_id").alias("keep_id")).distinct()


def keep_most_complete(
    groups: DataFrame, df: DataFrame, columns: Sequence[str] | None = None, row_id: str = "row_id"
) -> DataFrame:
    """Fewest empty cells; the lowest id among equals."""
    columns = columns or [c for c in df.columns if c != row_id]
    gaps = reduce(
        Column.__add__, [is_empty(as_col(c).cast("string")).cast("int") for c in columns], F.lit(0)
    )
    counted = df.select(as_col(row_id).alias("row_id"), gaps.alias("_gaps"))
    return _best(groups.join(unsent(counted), "row_id"), F.col("_gaps"))


def keep_longest(groups: DataFrame) -> DataFrame:
    """Longest comparison value; the lowest id among equals."""
    return _best(groups, -F.length("comparison_value"))


def keep_policy(
    groups: DataFrame, policy: str = "leader", df: DataFrame | None = None, row_id: str = "row_id"
) -> DataFrame:
    """Decisions ``(leader_id, keep_id)`` by a named policy."""
    if policy == "leader":
        return keep_leader(groups)
    if policy == "longest":
        return keep_longest(groups)
    if policy == "most_complete":
        if df is None:
            raise ValueError("the most_complete policy needs the table")
        return keep_most_complete(groups, df, row_id=row_id)
    raise ValueError(f"unknown policy: {policy}")


def _valid_decisions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    members = groups.select("leader_id", F.col("row_id").alias("keep_id"))
    named = decisions.join(unsent(members), ["leader_id", "keep_id"], "left_semi")
    return named.groupBy("leader_id").agg(F.min("keep_id").alias("keep_id"))


def decide_survivors(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Ids to remove: all members but the one to keep, in groups with a valid decision.

    A group without a decision, or whose decision names a row outside it, keeps all members. The
    lowest of several named rows counts.
    """
    kept = _valid_decisions(groups, decisions)
    return (
        join_hot(groups, kept, "leader_id", spread_by=F.col("row_id"))
        .filter("row_id <> keep_id")
        .select("row_id")
        .distinct()
    )


def invalid_decisions(groups: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions for an unknown group, or that name a row outside the group."""
    members = groups.select("leader_id", F.col("row_id").alias("keep_id"))
    return decisions.join(unsent(members), ["leader_id", "keep_id"], "left_anti")


def removals_from_replies(
    groups: DataFrame, replies: DataFrame, text: str = "text"
) -> DataFrame:
    """Ids to remove by group blocks; of a reply whose blocks decide nothing, by its bare id list.

    Where ``replies`` say which group each is about (``leader_id``), a list counts for its members only.
    """
    asked = ["leader_id"] if "leader_id" in replies.columns else []
    reply = F.xxhash64(text, *asked).alias("_reply")
    told = replies.select(reply, F.col(text).alias("text"), *asked)
    blocks = durable(parse_decisions(told, "text", keep=("_reply",)))
    by_block = decide_survivors(groups, blocks)
    # A reply of which no block removes anything may name rows in a bare list.
    members = groups.select("leader_id", F.col("row_id").alias("keep_id"))
    working = blocks.join(unsent(members), ["leader_id", "keep_id"], "left_semi").select("_reply")
    silent = told.join(unsent(working.distinct()), "_reply", "left_anti")
    listed = parse_removal_list(silent, "text", keep=tuple(asked))
    if asked:
        listed = listed.join(unsent(groups.select("leader_id", "row_id")), ["leader_id", "row_id"], "left_semi")
    return by_block.unionByName(listed.select("row_id")).distinct()


def remove_rows(df: DataFrame, ids: DataFrame, row_id: str = "row_id") -> DataFrame:
    return df.join(unsent(ids.select(F.col("row_id").alias(row_id))), row_id, "left_anti")


def dedupe_stats(
    df: DataFrame, groups: DataFrame, removals: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Rows before and after, groups, removed rows and the rate; counts rows really removed."""
    removed = df.select(F.col(row_id).alias("row_id")).join(
        unsent(removals.select("row_id").distinct()), "row_id", "left_semi"
    )
    names = ("original_count", "duplicate_groups", "duplicates_removed")
    sources = (df, groups.select("leader_id").distinct(), removed)

    def counted(place: int, source: DataFrame) -> DataFrame:
        n = F.count(F.lit(1))
        zero = F.lit(0).cast("long")
        return source.agg(*[(n if i == place else zero).alias(c) for i, c in enumerate(names)])

    parts = [counted(i, s) for i, s in enumerate(sources)]
    total = reduce(DataFrame.unionByName, parts).agg(*[F.sum(c).alias(c) for c in names])
    return total.withColumn(
        "final_count", F.col("original_count") - F.col("duplicates_removed")
    ).withColumn("rate_pct", percent(F.col("duplicates_removed"), F.col("original_count")))
