"""Stage 1: headers, excluded columns and text cleaning in one projection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from sparkscour.functions.text import as_col, clean_text
from sparkscour.operators.columns import clean_headers, drop_excluded
from sparkscour.operators.statistics import preclean_stats, preclean_totals


def _headed(df: DataFrame, exclusions: Sequence[str], row_id: str) -> tuple[DataFrame, int]:
    ids = [c for c in df.columns if c == row_id]
    headed = clean_headers(df)
    kept = drop_excluded(headed, [x for x in exclusions if x not in ids])
    return kept, len(headed.columns) - len(kept.columns)


def _text_columns(df: DataFrame, row_id: str) -> list[str]:
    return [c for c, t in df.dtypes if t == "string" and c != row_id]


def preclean(
    df: DataFrame,
    exclusions: Sequence[str] = (),
    row_id: str = "row_id",
    mode: str = "drop",
) -> DataFrame:
    """Clean the headers, drop the excluded columns and clean every remaining text cell.

    ``mode='keep'`` leaves excluded columns in the table, uncleaned. Works on streams.
    """
    if mode not in ("drop", "keep"):
        raise ValueError(f"unknown mode: {mode}")
    headed = _headed(df, exclusions if mode == "drop" else (), row_id)[0]
    cleaned = set(_text_columns(headed, row_id)) - set(exclusions)
    return headed.select(
        *[clean_text(c).alias(c) if c in cleaned else as_col(c) for c in headed.columns]
    )


def preclean_report(
    df: DataFrame, exclusions: Sequence[str] = (), row_id: str = "row_id"
) -> tuple[DataFrame, DataFrame]:
    """Changed values per column, and the totals, of ``preclean`` on the same arguments."""
    headed, removed = _headed(df, exclusions, row_id)
    stats = preclean_stats(headed, _text_columns(headed, row_id))
    return stats, preclean_totals(stats, removed)
