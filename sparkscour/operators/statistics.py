"""Counts of what text cleaning changed."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, clean_text


def preclean_stats(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values that cleaning changes, per column, from one pass over the uncleaned table."""
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, modified_count long, total_count long"
        )
    changed = [
        F.count_if(~as_col(c).eqNullSafe(clean_text(c))).alias(f"n{i}")
        for i, c in enumerate(columns)
    ]
    rows = [
        F.struct(
            F.lit(c).alias("column"),
            F.col(f"n{i}").alias("modified_count"),
            F.col("total").alias("total_count"),
        )
        for i, c in enumerate(columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("total"), *changed).select(F.inline(F.array(*rows)))


def preclean_totals(stats: DataFrame, columns_removed: int = 0) -> DataFrame:
    """Overall counts: rows, columns kept and removed, columns and values changed."""
    return stats.agg(
        F.coalesce(F.max("total_count"), F.lit(0)).alias("rows"),
        F.count(F.lit(1)).alias("columns"),
        F.lit(columns_removed).cast("long").alias("columns_removed"),
        F.count_if(F.col("modified_count") > 0).alias("columns_changed"),
        F.coalesce(F.sum("modified_count"), F.lit(0)).alias("values_changed"),
    )
