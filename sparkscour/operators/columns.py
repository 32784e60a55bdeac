"""Header cleaning, column removal, renaming and numeric coercion, each as one projection."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, clean_text
from sparkscour.functions.validity import leading_number
from sparkscour.sources.contracts import Contract, rules_of


def _require_distinct(names: Sequence[str]) -> None:
    twice = sorted(n for n, k in Counter(names).items() if k > 1)
    if twice:
        raise ValueError(f"several columns would share a name: {twice}")


def clean_headers(df: DataFrame) -> DataFrame:
    """Clean every header like a cell; an error names headers that become equal."""
    if not df.columns:
        return df
    one_row = df.sparkSession.sql("SELECT 1 AS one").select(
        *[clean_text(F.lit(name)).alias(f"h{i}") for i, name in enumerate(df.columns)]
    )
    cleaned = list(one_row.first())
    _require_distinct(cleaned)
    return df.toDF(*cleaned)


def drop_excluded(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Remove the columns whose name is on the list; unknown names are ignored."""
    gone = set(names)
    return df.select(*[as_col(c) for c in df.columns if c not in gone])


def rename_by_contract(
    df: DataFrame, contract: Contract, bind: str = "position", row_id: str = "row_id"
) -> DataFrame:
    """Rename all columns, excluded ones too.

    ``position`` binds rule ``index`` to the column at that place (``row_id`` does not count),
    whatever it is called, and ignores rules beyond the last column. ``name`` binds by the
    original name. Columns without a rule keep their name.
    """
    rules = rules_of(contract)
    data = [c for c in df.columns if c != row_id]
    if bind == "position":
        new = {data[r.index - 1]: r.name for r in rules if 1 <= r.index <= len(data)}
    elif bind == "name":
        new = {r.original_name: r.name for r in rules}
    else:
        raise ValueError(f"unknown binding: {bind}")
    names = [c if c == row_id else new.get(c, c) for c in df.columns]
    _require_distinct(names)
    return df.select(*[as_col(c).alias(n) for c, n in zip(df.columns, names)])


def coerce_numeric(df: DataFrame, columns: Sequence[str], default: float = 0.0) -> DataFrame:
    """Turn the columns into numbers by their leading number; ``default`` where there is none."""
    return df.withColumns({c: leading_number(c, default) for c in columns})
