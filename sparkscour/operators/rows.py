"""Row numbers and first rows without a single-partition window."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.functions.text import csv_line, csv_quote
from sparkscour.session import durable


# Offsets that are sent to every task: one row per partition and group.
MOST_OFFSETS = 200_000


def distributed_rank(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    rank_col: str = "rank",
) -> DataFrame:
    """1-based rank in ``order_by`` order, inside each ``within`` group if given.

    Range partitioning spreads any group, however large, over many tasks; rows that are equal in the
    order are spread by a hash of all their columns. Each sorted partition then numbers its own rows,
    and a table with one row per partition and group gives the offset to add. The sorted rows are
    checkpointed so that both steps see the same partitions.
    """
    keys = [*within, *order_by]
    hashable = [F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()]
    ranged = df.withColumn("_tie", F.xxhash64(*hashable))
    ranged = ranged.repartitionByRange(*keys, "_tie").sortWithinPartitions(*keys, "_tie")
    placed = durable(
        ranged.drop("_tie")
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_place", F.monotonically_increasing_id())
    )
    starts = placed.groupBy("_part", *within).agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_place").alias("_first")
    )
    offsets = _offsets(starts, ["_part"], within)
    return (
        placed.join(offsets, ["_part", *within])
        .withColumn(rank_col, F.col("_offset") + F.col("_place") - F.col("_first") + 1)
        .drop("_part", "_place", "_first", "_offset")
    )


def _offsets(starts: DataFrame, order_by: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """``_offset``, the sum of ``_rows`` before each row; sent to every task if few enough."""
    earlier = (
        Window.partitionBy(*within) if within else Window.partitionBy(F.lit(0))
    ).orderBy(*order_by).rowsBetween(Window.unboundedPreceding, -1)
    offsets = durable(
        starts.withColumn("_offset", F.coalesce(F.sum("_rows").over(earlier), F.lit(0))).drop("_rows")
    )
    return F.broadcast(offsets) if offsets.count() <= MOST_OFFSETS else offsets


def _file_rank(df: DataFrame, rank_col: str) -> DataFrame:
    """1-based rank in the order of files, blocks and lines, without sorting or shuffling rows.

    A block is read by one task in its order, so a line's place is known from its block's count and
    first position; only one row per block is summed up.
    """
    # _pos only has meaning in the scan that made it, so it is fixed by one write.
    placed = durable(df)
    block = ["_file", "_block"]
    starts = placed.groupBy(*block).agg(F.count(F.lit(1)).alias("_rows"), F.min("_pos").alias("_first"))
    return (
        placed.join(_offsets(starts, block), block)
        .withColumn(rank_col, F.col("_offset") + F.col("_pos") - F.col("_first") + 1)
        .drop(*block, "_pos", "_first", "_offset")
    )


def with_row_id(
    df: DataFrame,
    order_by: Sequence[str] | None = None,
    id_col: str | None = None,
    row_id: str = "row_id",
) -> DataFrame:
    """Give every row a stable 1-based ``row_id``.

    ``id_col`` is used as it is when given. Otherwise rows are numbered in ``order_by`` order;
    without it, in file order from the position columns of ``read_table(with_position=True)``.
    """
    if id_col is not None:
        return df.withColumn(row_id, F.col(id_col).cast("long"))
    if row_id in df.columns:
        raise ValueError(f"column {row_id} is reserved")
    position = ["_file", "_block", "_pos"]
    if order_by is None:
        if not set(position) <= set(df.columns):
            raise ValueError("pass id_col, order_by, or a table read with_position=True")
        return _file_rank(df, row_id)
    return distributed_rank(df, order_by, rank_col=row_id)


def first_rows(df: DataFrame, n: int, row_id: str = "row_id") -> DataFrame:
    """The first ``n`` rows by id; planned as a top-n per partition and a merge."""
    return df.orderBy(row_id).limit(n)


def head_sample(
    df: DataFrame, n: int = 5, row_id: str = "row_id", columns: Sequence[str] | None = None
) -> DataFrame:
    """The first ``n`` rows as CSV lines (``row_id``, ``header``, ``line``), ID put first."""
    columns = [c for c in (columns or df.columns) if c != row_id]
    header = F.concat_ws(",", F.lit("ID"), *[csv_quote(F.lit(c)) for c in columns])
    line = csv_line(row_id, *columns)
    return first_rows(df, n, row_id).select(
        row_id, header.alias("header"), line.alias("line")
    )
