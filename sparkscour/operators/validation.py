"""Pattern validation: valid and invalid cells, and statistics before and after cleaning."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col
from sparkscour.functions.validity import ANY_VALUE, is_empty, percent, usable_pattern
from sparkscour.sources.contracts import ColumnRule, Contract, active_rules, rules_of


def checked_rules(df: DataFrame, contract: Contract) -> list[ColumnRule]:
    """Active rules with a pattern other than catch-all, for columns that ``df`` has."""
    return [r for r in active_rules(contract) if r.regex != ANY_VALUE and r.name in df.columns]


def _cell_checks(
    df: DataFrame, rules: Sequence[ColumnRule], mode: str
) -> list[tuple[ColumnRule, Column, Column, Column]]:
    """(rule, value, is empty, is invalid) per column; patterns are literals in the plan."""
    checks = []
    for rule in rules:
        value = as_col(rule.name).cast("string")
        empty = is_empty(value, mode)
        pattern = usable_pattern(df.sparkSession, rule.regex)
        bad = F.lit(False) if pattern is None else ~empty & ~value.rlike(pattern)
        checks.append((rule, value, empty, bad))
    return checks


def split_valid_invalid(
    df: DataFrame, contract: Contract, mode: str = "cleaner", row_id: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """Cells ``(row_id, column, value)`` that pass and that fail; empty ones pass as ``''``.

    Excluded and catch-all columns are left out. Only the wanted cells of a row are exploded, so
    the invalid side costs one scan and emits nothing for clean rows.
    """
    checks = _cell_checks(df, checked_rules(df, contract), mode)
    schema = "array<struct<column: string, value: string>>"

    def side(wanted: bool) -> DataFrame:
        cells = [
            F.when(
                bad if not wanted else ~bad,
                F.struct(
                    F.lit(rule.name).alias("column"),
                    F.when(empty, F.lit("")).otherwise(value).alias("value"),
                ),
            )
            for rule, value, empty, bad in checks
        ]
        listed = F.array_compact(F.array(*cells)) if cells else F.array().cast(schema)
        return df.select(as_col(row_id).alias("row_id"), F.inline(listed.cast(schema)))

    return side(True), side(False)


def invalid_cells(
    df: DataFrame, contract: Contract, mode: str = "validator", row_id: str = "row_id"
) -> DataFrame:
    return split_valid_invalid(df, contract, mode, row_id)[1]


def validation_stats(df: DataFrame, contract: Contract, mode: str = "validator") -> DataFrame:
    """Counts and percentages per checked column, from one aggregation over the table."""
    checks = _cell_checks(df, checked_rules(df, contract), mode)
    totals = [F.count(F.lit(1)).alias("total")]
    rows = []
    for i, (rule, _, empty, bad) in enumerate(checks):
        totals += [F.count_if(bad).alias(f"bad{i}"), F.count_if(empty).alias(f"empty{i}")]
        total, invalid = F.col("total"), F.col(f"bad{i}")
        rows.append(
            F.struct(
                F.lit(rule.name).alias("column"),
                F.lit(rule.original_name).alias("original_name"),
                F.lit(rule.regex).alias("regex"),
                total.alias("total_count"),
                (total - invalid).alias("valid_count"),
                invalid.alias("invalid_count"),
                F.col(f"empty{i}").alias("empty_count"),
                percent(total - invalid, total).alias("valid_pct"),
                percent(invalid, total).alias("invalid_pct"),
            )
        )
    if not rows:
        return df.sparkSession.createDataFrame(
            [],
            "column string, original_name string, regex string, total_count long, "
            "valid_count long, invalid_count long, empty_count long, valid_pct double, "
            "invalid_pct double",
        )
    return df.agg(*totals).select(F.inline(F.array(*rows)))


def validation_summary(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of totals over the statistics of all columns, before and after."""
    joined = _before_after(before, after)
    total = F.sum("total_count")
    valid_before, valid_after = F.sum("valid_before"), F.sum("valid_after")
    return (
        joined.agg(
            F.count(F.lit(1)).alias("columns"),
            F.coalesce(total, F.lit(0)).alias("data_points"),
            F.coalesce(valid_before, F.lit(0)).alias("valid_before"),
            F.coalesce(F.sum("invalid_before"), F.lit(0)).alias("invalid_before"),
            F.coalesce(valid_after, F.lit(0)).alias("valid_after"),
            F.coalesce(F.sum("invalid_after"), F.lit(0)).alias("invalid_after"),
        )
        .withColumn("valid_before_pct", percent(F.col("valid_before"), F.col("data_points")))
        .withColumn("valid_after_pct", percent(F.col("valid_after"), F.col("data_points")))
        .withColumn(
            "improvement", F.round(F.col("valid_after_pct") - F.col("valid_before_pct"), 2)
        )
    )


def significant_improvements(
    before: DataFrame, after: DataFrame, minimum: float = 5.0
) -> DataFrame:
    """Columns whose valid share rose by at least ``minimum`` points, best first."""
    gain = F.round(F.col("valid_after_pct") - F.col("valid_before_pct"), 2)
    return (
        _before_after(before, after)
        .select("column", gain.alias("improvement"))
        .filter(F.col("improvement") >= minimum)
        .orderBy(F.desc("improvement"), "column")
    )


def _before_after(before: DataFrame, after: DataFrame) -> DataFrame:
    """Statistics side by side; a column without an ``after`` keeps its ``before``."""

    def named(stats: DataFrame, when: str) -> DataFrame:
        return stats.select(
            "column",
            F.col("valid_count").alias(f"valid_{when}"),
            F.col("invalid_count").alias(f"invalid_{when}"),
            F.col("valid_pct").alias(f"valid_{when}_pct"),
            *([F.col("total_count")] if when == "before" else []),
        )

    joined = named(before, "before").join(named(after, "after"), "column", "left")
    return joined.withColumns(
        {
            c.format("after"): F.coalesce(c.format("after"), c.format("before"))
            for c in ("valid_{}", "invalid_{}", "valid_{}_pct")
        }
    )


def column_outcomes(
    df: DataFrame, contract: Contract, mode: str = "cleaner"
) -> DataFrame:
    """What cleaning has to do for each column of the contract, in index order."""
    rules = rules_of(contract)
    checks = _cell_checks(df, checked_rules(df, rules), mode)
    counts = [F.count_if(bad).alias(f"bad{i}") for i, (_, _, _, bad) in enumerate(checks)]
    place = {rule.name: i for i, (rule, _, _, _) in enumerate(checks)}
    rows = []
    for rule in rules:
        if rule.is_excluded:
            outcome, bad = F.lit("excluded"), F.lit(0).cast("long")
        elif rule.regex == ANY_VALUE:
            outcome, bad = F.lit("skipped"), F.lit(0).cast("long")
        else:
            i = place.get(rule.name)
            bad = F.lit(0).cast("long") if i is None else F.col(f"bad{i}")
            outcome = F.when(bad > 0, F.lit("cleaned")).otherwise(F.lit("already valid"))
        rows.append(
            F.struct(
                F.lit(rule.index).alias("index"),
                F.lit(rule.name).alias("column"),
                outcome.alias("outcome"),
                bad.alias("invalid_count"),
            )
        )
    return df.agg(F.count(F.lit(1)).alias("total"), *counts).select(F.inline(F.array(*rows)))
