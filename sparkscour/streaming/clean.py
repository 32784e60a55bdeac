"""Text cleaning, validation and known corrections on a stream.

These stages look at one row at a time, so they need neither state nor watermarks: the batch
functions run on streaming DataFrames as they are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from sparkscour.operators.columns import rename_by_contract
from sparkscour.operators.patches import apply_cell_patches
from sparkscour.operators.validation import invalid_cells
from sparkscour.plans.preclean import preclean
from sparkscour.sources.contracts import Contract, rules_of


def clean_stream(
    stream: DataFrame,
    contract: Contract,
    exclusions: Sequence[str] = (),
    cell_patches: DataFrame | None = None,
    row_id: str = "row_id",
) -> tuple[DataFrame, DataFrame]:
    """The cleaned stream under contract names, and the stream of its invalid cells.

    ``cell_patches`` is a static table of corrections, joined to each micro-batch.
    """
    rules = rules_of(contract)
    table = rename_by_contract(preclean(stream, exclusions, row_id), rules, row_id=row_id)
    if cell_patches is not None:
        table = apply_cell_patches(table, cell_patches, row_id)
    return table, invalid_cells(table, rules, "cleaner", row_id)


def write_available(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append all data that is there now as Parquet and stop; a rerun takes up where it ended."""
    return (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
