"""Stage 6: numeric columns, isolation forest, outlier removal and the split."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.validity import leading_number
from sparkscour.operators.outliers import (
    OUTLIER_SCORE,
    iforest_fit,
    iforest_score,
    numeric_features,
    outlier_report,
)
from sparkscour.operators.split import split_rows
from sparkscour.session import durable
from sparkscour.sources.contracts import Contract, active_rules


# The score beside the table's own columns.
SCORE = "_isolation_score"


@dataclass
class IsoSplit:
    table: DataFrame
    outliers: DataFrame
    scores: DataFrame


def numeric_columns(df: DataFrame, contract: Contract) -> list[str]:
    names = [r.name for r in active_rules(contract, ("int", "float"))]
    return [n for n in names if n in df.columns]


def iso_split(
    df: DataFrame,
    contract: Contract,
    threshold: float = OUTLIER_SCORE,
    seed: int = 42,
    trees: int = 100,
    sample: int = 256,
    exact: bool = True,
    row_id: str = "row_id",
) -> IsoSplit:
    """Drop outliers by the contract's numeric columns and split the rest 70/15/15."""
    columns = numeric_columns(df, contract)
    if not columns:
        raise ValueError("the contract has no numeric columns in use")
    nodes = iforest_fit(numeric_features(df, columns, row_id), columns, trees, sample, seed, row_id)
    # The forest reads the coerced numbers of a row, the table keeps its texts; both stay together.
    numbers = [leading_number(c) for c in columns]
    scored = durable(iforest_score(df, nodes, columns, row_id, numbers, SCORE))
    kept = scored.filter(~(F.col(SCORE) > threshold)).select(*df.columns)
    scores = scored.select(
        row_id, *[v.alias(c) for v, c in zip(numbers, columns)], F.col(SCORE).alias("score")
    )
    return IsoSplit(
        split_rows(kept, seed=seed, exact=exact, row_id=row_id),
        outlier_report(scores, columns, threshold, row_id),
        scores,
    )
