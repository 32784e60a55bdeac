"""Stage 3: comparison key, duplicate groups, survivors and the table without the others."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import comparison_key
from sparkscour.operators.batches import decide_groups
from sparkscour.operators.groups import (
    REQUEST_MEMBERS,
    group_members,
    group_requests,
    group_sizes,
    leader_groups,
    part_of,
)
from sparkscour.operators.pairs import require_threshold
from sparkscour.operators.reply_text import parse_decisions, parse_removal_list
from sparkscour.operators.survivors import (
    decide_survivors,
    dedupe_stats,
    keep_policy,
    remove_rows,
    removals_from_replies,
)
from sparkscour.session import durable, join_hot, unsent
from sparkscour.sources.contracts import Contract, rules_of


@dataclass
class Deduped:
    table: DataFrame
    reason: str | None = None
    groups: DataFrame | None = None
    removals: DataFrame | None = None
    stats: DataFrame | None = None
    configuration: dict = field(default_factory=dict)
    make_requests: Callable[[], DataFrame] | None = None

    @property
    def requests(self) -> DataFrame | None:
        """The request texts of all groups, built when they are asked for."""
        return self.make_requests() if self.make_requests else None


def removals_by_decider(
    groups: DataFrame,
    df: DataFrame,
    decider: Callable[[str], str | None],
    row_id: str = "row_id",
    max_members: int = REQUEST_MEMBERS,
) -> DataFrame:
    """Ids to remove by a decider of group texts.

    A group above ``max_members`` duplicates is decided in rounds: the rows that its parts keep are
    the members of the next round, until one request covers all that are left, so the row that stays
    is always one that a decision named. Of a part that is answered by a bare id list, the members that
    aren't listed go on. A group of which some part isn't decided keeps all rows.
    """
    if max_members < 4:
        raise ValueError("a request needs room for at least 4 members")
    sizes = groups.groupBy("leader_id").agg((F.count(F.lit(1)) - 1).alias("_n"))
    large = durable(sizes.filter(F.col("_n") > max_members).select("leader_id"))
    small = join_hot(groups, large, "leader_id", "left_anti", spread_by=F.col("row_id"))
    replies = decide_groups(group_requests(small, df, row_id=row_id, max_members=max_members), decider)
    removed = removals_from_replies(small, replies)
    if large.isEmpty():
        return removed
    left = join_hot(groups, large, "leader_id", "left_semi", spread_by=F.col("row_id"))
    left = durable(left.select("leader_id", "row_id"))
    both, part = ["leader_id", "row_id"], ["leader_id", "part"]
    final = None
    while not left.isEmpty():
        requests = durable(group_requests(left, df, row_id=row_id, max_members=max_members))
        told = decide_groups(requests, decider)
        named = parse_decisions(told, keep=("part",)).withColumnRenamed("keep_id", "row_id")
        named = named.join(unsent(left), both, "left_semi")
        one = durable(named.groupBy(*part).agg(F.min("row_id").alias("row_id")))
        # A part of which no block decides keeps its members but for those of its bare id list.
        silent = told.join(unsent(one), part, "left_anti")
        gone = durable(parse_removal_list(silent, keep=part))
        lists = durable(silent.filter(F.col("text").rlike(r"\[[\d\s,]*\]")).select(*part))
        duplicates = left.filter("row_id <> leader_id")
        sizes = duplicates.groupBy("leader_id").agg(F.count(F.lit(1)).alias("_n"))
        placed = join_hot(duplicates, sizes, "leader_id", spread_by=F.col("row_id"))
        placed = placed.select(*both, part_of(F.col("_n"), max_members).alias("part"))
        unlisted = placed.join(unsent(lists), part, "left_semi").join(unsent(gone), [*part, "row_id"], "left_anti")
        leaders = lists.select("leader_id", F.col("leader_id").alias("row_id")).distinct()
        leaders = leaders.join(unsent(gone), both, "left_anti")
        kept = one.select(*both).unionByName(unlisted.select(*both)).unionByName(leaders).distinct()
        answered = one.select(*part).unionByName(lists).groupBy("leader_id").agg(F.count(F.lit(1)).alias("_told"))
        parts = requests.groupBy("leader_id").agg(F.count(F.lit(1)).alias("_parts"))
        decided = parts.join(unsent(answered), "leader_id").filter("_told = _parts")
        kept = durable(join_hot(kept, decided, "leader_id", "left_semi", spread_by=F.col("row_id")))
        counts = kept.groupBy("leader_id").agg(
            F.count(F.lit(1)).alias("_kept"), F.count_if(F.col("row_id") == F.col("leader_id")).alias("_leads")
        )
        state = decided.join(unsent(sizes), "leader_id").join(unsent(counts), "leader_id", "left").na.fill(0, ["_kept", "_leads"])
        # One request, one row that every part keeps, or a round that leaves all rows is the decision.
        over = (F.col("_parts") == 1) | (F.col("_kept") <= 1) | (F.col("_kept") - F.col("_leads") >= F.col("_n"))
        state = durable(state.select("leader_id", over.alias("_over")))
        settled = state.filter("_over").select("leader_id")
        ended = join_hot(groups.select(*both), settled, "leader_id", "left_semi", spread_by=F.col("row_id"))
        ended = ended.join(unsent(kept), both, "left_anti").select("row_id")
        final = ended if final is None else final.unionByName(ended)
        going = state.filter(~F.col("_over")).select("leader_id")
        again = join_hot(kept, going, "leader_id", "left_semi", spread_by=F.col("row_id"))
        heads = going.select("leader_id", F.col("leader_id").alias("row_id"))
        left = durable(again.unionByName(heads).distinct())
    return removed.unionByName(final).distinct()


def dedupe(
    df: DataFrame,
    contract: Contract,
    strategy: str = "levenshtein",
    threshold: float | None = None,
    policy: str = "leader",
    decisions: DataFrame | None = None,
    decider: Callable[[str], str | None] | None = None,
    show_input: bool = False,
    row_id: str = "row_id",
    **options: object,
) -> Deduped:
    """Remove duplicates by the contract's unique columns (bound by original name).

    Survivors come from ``decisions``, else from a ``decider`` of group texts, else from
    ``policy``. Without a unique column, without a group, or with ``show_input``, the table stays
    as it is and ``reason`` says why.
    """
    t = require_threshold(threshold)
    unique = [r.original_name for r in rules_of(contract) if r.is_unique]
    settings = {"unique_columns": unique, "threshold": t, "strategy": strategy, "policy": policy}
    present = [c for c in unique if c in df.columns]
    if not present:
        return Deduped(df, "no unique columns", configuration=settings)
    keyed = df.select(
        F.col(row_id).alias("row_id"), comparison_key(*present).alias("comparison_value")
    )
    groups = durable(leader_groups(keyed, strategy, t, **options))
    if groups.isEmpty():
        return Deduped(df, "no duplicate groups", groups, configuration=settings)
    def requests() -> DataFrame:
        return group_requests(groups, df, row_id=row_id)

    if show_input:
        return Deduped(df, "requests only", groups, configuration=settings, make_requests=requests)
    if decisions is not None:
        removals = decide_survivors(groups, decisions)
    elif decider is not None:
        removals = removals_by_decider(groups, df, decider, row_id)
    else:
        kept = keep_policy(groups, policy, df, row_id).select(F.col("keep_id").alias("row_id"))
        # Every group has one kept row and every row is in one group.
        removals = groups.select("row_id").join(unsent(kept), "row_id", "left_anti")
    removals = durable(removals)
    return Deduped(
        remove_rows(df, removals, row_id),
        None,
        groups,
        removals,
        dedupe_stats(df, groups, removals, row_id),
        settings,
        requests,
    )


def dedupe_report(result: Deduped) -> dict[str, DataFrame]:
    """Configuration, statistics, group sizes and members, and removed ids as tables."""
    spark = result.table.sparkSession
    settings = [(k, str(v)) for k, v in result.configuration.items()]
    report = {"configuration": spark.createDataFrame(settings, "setting string, value string")}
    if result.groups is not None:
        report["members"] = group_members(result.groups)
        report["sizes"] = group_sizes(result.groups)
    if result.stats is not None:
        report["statistics"] = result.stats
        report["removed"] = result.removals.orderBy("row_id")
    return report
