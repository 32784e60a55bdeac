"""Stage 5: contract names, row patches, cell patches, validation before and after, flags."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.operators.columns import rename_by_contract
from sparkscour.operators.patches import (
    build_change_log,
    change_summary,
    change_totals,
    flag_unresolved,
    patched_side_by_side,
    status_report,
)
from sparkscour.operators.validation import (
    invalid_cells,
    significant_improvements,
    validation_stats,
    validation_summary,
)
from sparkscour.session import durable
from sparkscour.sources.contracts import Contract, rules_of

ROW_PATCHES = "row_id long, values array<string>, flagged boolean, seq long"
CELL_PATCHES = (
    "row_id long, column string, corrected_value string, source string, seq long"
)


@dataclass
class Stitched:
    table: DataFrame
    before: DataFrame
    after: DataFrame
    change_log: DataFrame
    still_invalid: DataFrame

    def summary(self) -> DataFrame:
        return validation_summary(self.before, self.after)

    def improvements(self, minimum: float = 5.0) -> DataFrame:
        return significant_improvements(self.before, self.after, minimum)

    def changes(self) -> DataFrame:
        return change_summary(self.change_log)

    def totals(self) -> DataFrame:
        return change_totals(self.change_log)

    def report(self) -> DataFrame:
        return status_report(self.change_log, self.after)


def stitch(
    df: DataFrame,
    contract: Contract,
    row_patches: DataFrame | None = None,
    cell_patches: DataFrame | None = None,
    mode: str = "validator",
    row_id: str = "row_id",
) -> Stitched:
    """Apply a contract and its corrections; validation and flags are always computed.

    Excluded columns are renamed and kept. The table is joined to all corrections once, and its values
    before and after the cell patches are written side by side, so that statistics, log and flags read
    them without joining again.
    """
    rules = rules_of(contract)
    spark = df.sparkSession
    if row_patches is None:
        row_patches = spark.createDataFrame([], ROW_PATCHES)
    if cell_patches is None:
        cell_patches = spark.createDataFrame([], CELL_PATCHES)
    named = rename_by_contract(df, rules, row_id=row_id)
    both = durable(patched_side_by_side(named, row_patches, cell_patches, row_id))
    names = [c for c in named.columns if c != row_id]
    row_patched = both.select(row_id, *[F.col("_before").getField(c).alias(c) for c in names])
    table = both.select(row_id, *[F.col("_after").getField(c).alias(c) for c in names])
    failing = invalid_cells(table, rules, mode, row_id)
    log = durable(build_change_log(row_patched, cell_patches, row_id))
    return Stitched(
        table,
        validation_stats(row_patched, rules, mode),
        validation_stats(table, rules, mode),
        flag_unresolved(log, failing, rules, cell_patches),
        failing,
    )
