"""Row and cell corrections as joins, and the change log they leave."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.functions.text import as_col
from sparkscour.functions.validity import percent
from sparkscour.session import join_hot, unsent
from sparkscour.sources.contracts import Contract, rules_of

# Fixed value: the source of entries that only validation has.
VALIDATION_SOURCE = "N/A (Regex Validation)"
# Entries of one cell that are put in order by one task.
LOG_STRETCH = 100_000


def latest_row_patches(row_patches: DataFrame) -> DataFrame:
    """The last patch of each row."""
    return row_patches.groupBy("row_id").agg(F.max_by("values", F.struct("seq")).alias("values"))


def latest_cell_patches(cell_patches: DataFrame) -> DataFrame:
    """The last patch of each cell: sources in name order, then lines in order."""
    return cell_patches.groupBy("row_id", "column").agg(
        F.max_by("corrected_value", F.struct("source", "seq")).alias("corrected_value")
    )


def _cell_map(cell_patches: DataFrame, names: list[str]) -> DataFrame:
    """One map per row; it has at most one entry per column of the table."""
    pairs = F.collect_list(F.struct("column", "corrected_value"))
    return (
        latest_cell_patches(cell_patches.filter(F.col("column").isin(names)))
        .groupBy("row_id")
        .agg(F.map_from_entries(pairs).alias("_cells"))
    )


def _row_patched(names: list[str], types: dict[str, str]) -> list[Column]:
    """Value i of the patch replaces column i; a shorter patch leaves the tail alone."""
    values = F.col("_values")
    return [
        F.when(F.size(values) > i, F.get(values, F.lit(i)).try_cast(types[n]))
        .otherwise(as_col(n))
        .alias(n)
        for i, n in enumerate(names)
    ]


def _cell_patched(names: list[str], types: dict[str, str]) -> list[Column]:
    cells = F.col("_cells")
    return [
        F.when(F.map_contains_key(cells, F.lit(n)), F.element_at(cells, F.lit(n)).try_cast(types[n]))
        .otherwise(as_col(n))
        .alias(n)
        for n in names
    ]


def _data_columns(df: DataFrame, row_id: str) -> tuple[list[str], dict[str, str]]:
    return [c for c in df.columns if c != row_id], dict(df.dtypes)


def apply_row_patches(
    df: DataFrame, row_patches: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Replace the leading values of patched rows; ids outside the table have no effect."""
    names, types = _data_columns(df, row_id)
    patch = latest_row_patches(row_patches).withColumnsRenamed(
        {"row_id": row_id, "values": "_values"}
    )
    return df.join(unsent(patch), row_id, "left").select(row_id, *_row_patched(names, types))


def apply_cell_patches(
    df: DataFrame, cell_patches: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Replace patched cells; unknown rows and columns have no effect."""
    names, types = _data_columns(df, row_id)
    patch = _cell_map(cell_patches, names).withColumnRenamed("row_id", row_id)
    return df.join(unsent(patch), row_id, "left").select(row_id, *_cell_patched(names, types))


def patched_side_by_side(
    df: DataFrame, row_patches: DataFrame, cell_patches: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """Row patches, then cell patches, with the table joined (and shuffled) only once.

    Returns the id and two structs of all other columns: ``_before`` the cell patches and ``_after``.
    """
    names, types = _data_columns(df, row_id)
    patch = (
        latest_row_patches(row_patches)
        .withColumnRenamed("values", "_values")
        .join(_cell_map(cell_patches, names), "row_id", "full_outer")
        .withColumnRenamed("row_id", row_id)
    )
    joined = df.join(unsent(patch), row_id, "left").select(
        row_id, *_row_patched(names, types), "_cells"
    )
    return joined.select(
        row_id,
        F.struct(*[as_col(n) for n in names]).alias("_before"),
        F.struct(*_cell_patched(names, types)).alias("_after"),
    )


def build_change_log(
    before: DataFrame, cell_patches: DataFrame, row_id: str = "row_id"
) -> DataFrame:
    """One entry per patch of a cell that exists, in the order the patches apply.

    The current value is what the patch found: the cell itself, or the patch before it. Patches
    of one cell are ordered in stretches of ``LOG_STRETCH`` lines, so no task has to hold all
    patches of a cell. A patch without source or place comes before those that have one.
    """
    names = [c for c in before.columns if c != row_id]
    cell = ["row_id", "column"]
    stretch = [*cell, "_source", "_stretch"]
    # The joins below need keys without nulls that sort as the nulls do.
    known = cell_patches.filter(F.col("column").isin(names)).withColumns(
        {
            "_source": F.concat(F.col("source").isNotNull().cast("int"), F.coalesce("source", F.lit(""))),
            "_stretch": F.coalesce(F.floor(F.col("seq") / LOG_STRETCH), F.lit(-(1 << 62))),
        }
    )
    inside = Window.partitionBy(*stretch).orderBy("seq")
    chained = known.withColumn("_n", F.row_number().over(inside)).withColumn(
        "_found", F.lag("corrected_value").over(inside)
    )
    ends = Window.partitionBy(*cell).orderBy("_source", "_stretch")
    earlier = (
        known.groupBy(*stretch)
        .agg(F.max_by("corrected_value", F.struct("seq")).alias("_end"))
        .withColumn("_earlier", F.lag(F.struct("_end")).over(ends))
        .drop("_end")
    )
    firsts = chained.join(earlier, stretch)
    original = F.create_map(
        *[part for n in names for part in (F.lit(n), as_col(n).cast("string"))]
    )
    originals = before.select(as_col(row_id).alias("row_id"), original.alias("_cells"))
    current = (
        F.when(F.col("_n") > 1, F.col("_found"))
        .when(F.col("_earlier").isNotNull(), F.col("_earlier._end"))
        .otherwise(F.element_at("_cells", F.col("column")))
    )
    return (
        join_hot(
            firsts,
            originals,
            "row_id",
            spread_by=F.struct("column", "source", "seq"),
            measured=cell_patches,
        )
        .select(
            *cell,
            "source",
            "seq",
            F.coalesce(current, F.lit("")).alias("current_value"),
            F.coalesce("corrected_value", F.lit("")).alias("corrected_value"),
        )
        .withColumn("needs_change", F.col("current_value") != F.col("corrected_value"))
    )


def flag_unresolved(
    change_log: DataFrame,
    still_invalid: DataFrame,
    contract: Contract,
    cell_patches: DataFrame | None = None,
) -> DataFrame:
    """Mark entries whose cell is invalid after cleaning; add invalid cells without an entry.

    With the ``cell_patches`` behind the log, the log is not computed twice to find hot cells.
    """
    patterns = {"": "", **{r.name: r.regex for r in rules_of(contract)}}
    pattern = F.create_map(*[F.lit(x) for pair in patterns.items() for x in pair])
    failing = still_invalid.select(
        "row_id",
        "column",
        F.col("value").alias("_value"),
        F.concat(
            F.lit("Value '"),
            F.col("value"),
            F.lit("' does not match regex: "),
            F.coalesce(F.element_at(pattern, F.col("column")), F.lit("")),
        ).alias("_reason"),
    )
    cell = ["row_id", "column"]
    marked = join_hot(
        change_log, failing, cell, "left", spread_by=F.struct("source", "seq"),
        measured=cell_patches,
    ).select(
        *cell,
        "source",
        "seq",
        "current_value",
        "corrected_value",
        "needs_change",
        F.col("_reason").isNotNull().alias("is_flagged"),
        F.coalesce("_reason", F.lit("")).alias("flag_reason"),
        F.col("_reason").isNotNull().alias("unable_to_fix"),
    )
    added = failing.join(unsent(change_log.select(*cell).distinct()), cell, "left_anti").select(
        *cell,
        F.lit(VALIDATION_SOURCE).alias("source"),
        F.lit(0).cast("long").alias("seq"),
        F.col("_value").alias("current_value"),
        F.col("_value").alias("corrected_value"),
        F.lit(False).alias("needs_change"),
        F.lit(True).alias("is_flagged"),
        F.col("_reason").alias("flag_reason"),
        F.lit(True).alias("unable_to_fix"),
    )
    return marked.unionByName(added).withColumn("status", entry_status())


def entry_status() -> Column:
    return (
        F.when(F.col("is_flagged"), "FLAGGED")
        .when(F.col("needs_change"), "CHANGED")
        .otherwise("VALID")
    )


def change_summary(change_log: DataFrame) -> DataFrame:
    """Entries, applied changes and flags per column."""
    return change_log.groupBy("column").agg(*_change_counts())


def change_totals(change_log: DataFrame) -> DataFrame:
    """The same counts over all columns, and the number of columns with entries."""
    per_column = change_summary(change_log)
    sums = [F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("entries", "applied", "flagged")]
    totals = per_column.agg(F.count(F.lit(1)).alias("columns"), *sums)
    return totals.withColumn("flagged_pct", percent(F.col("flagged"), F.col("entries")))


def _change_counts() -> list[Column]:
    return [
        F.count(F.lit(1)).alias("entries"),
        F.count_if("needs_change").alias("applied"),
        F.count_if("is_flagged").alias("flagged"),
    ]


def status_report(change_log: DataFrame, validation: DataFrame) -> DataFrame:
    """Log entries with the validation result of their column, by column and row."""
    stats = validation.select("column", "valid_pct", "invalid_count")
    # One row of statistics per table column.
    return change_log.join(F.broadcast(stats), "column", "left").orderBy(
        "column", "row_id", "source", "seq"
    )
