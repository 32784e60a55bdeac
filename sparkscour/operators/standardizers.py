"""Rule-based standard forms as cell patches, and flags for missing critical values."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.standardize import missing_critical
from sparkscour.functions.text import as_col
from sparkscour.functions.validity import is_empty


def standardize(
    df: DataFrame, rules: Mapping[str, Callable[[Column], Column]], row_id: str = "row_id"
) -> DataFrame:
    """Cell patches for the cells whose standard form differs; one scan, only changes are emitted.

    ``rules`` maps a column to a function of ``functions.standardize``. Empty cells and cells
    without a standard form are left alone.
    """
    changes = []
    for name, rule in rules.items():
        value = as_col(name).cast("string")
        form = rule(value)
        changes.append(
            F.when(
                ~is_empty(value, "unified") & form.isNotNull() & (form != value),
                F.struct(F.lit(name).alias("column"), form.alias("corrected_value")),
            )
        )
    return df.select(
        as_col(row_id).alias("row_id"), F.inline(F.array_compact(F.array(*changes)))
    ).select(
        "row_id",
        "column",
        "corrected_value",
        F.lit("standardize").alias("source"),
        F.lit(0).cast("long").alias("seq"),
    )


def flag_missing(
    df: DataFrame, critical: Sequence[str], mode: str = "unified", row_id: str = "row_id"
) -> DataFrame:
    """Rows with an empty critical column and the names of these columns."""
    empty = [is_empty(as_col(c).cast("string"), mode) for c in critical]
    missing = missing_critical(critical, empty)
    return df.select(as_col(row_id).alias("row_id"), missing.alias("missing")).filter(
        F.size("missing") > 0
    )
