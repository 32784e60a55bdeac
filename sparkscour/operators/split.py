"""Repeatable train, validate and test splits without sorting the table.

A row's place in the shuffle is the md5 of seed and id. Only the two cut places are needed: they
are found by counting rows per leading md5 digits and then looking into one bucket, so the split
itself is a map-side comparison.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col

# The ratios; sizes are rounded down and the rest goes to test.
RATIOS = (0.70, 0.15, 0.15)
# A cut is looked up in a bucket of at most this many rows.
BUCKET_ROWS = 100_000
DIGITS = 3


def shuffle_place(row_id: Column | str, seed: int) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), as_col(row_id).cast("string")))


def split_targets(n: int, ratios: Sequence[float] = RATIOS) -> tuple[int, int]:
    """Sizes of train and validate."""
    return math.floor(n * ratios[0]), math.floor(n * ratios[1])


def _counts(places: DataFrame, prefix: str = "") -> list[tuple[str, int]]:
    """Rows per next ``DIGITS`` digits after ``prefix``, in order; at most 16 ** DIGITS entries."""
    inside = places.filter(F.col("place").startswith(prefix)) if prefix else places
    digits = F.substring("place", 1, len(prefix) + DIGITS).alias("p")
    return sorted(tuple(r) for r in inside.groupBy(digits).count().collect())


def _place_of_rank(
    places: DataFrame, counts: list[tuple[str, int]], rank: int
) -> tuple[str, int] | None:
    """The ``rank``-th smallest (place, row_id), counted from 1; None for rank 0."""
    if rank <= 0:
        return None
    while True:
        for prefix, rows in counts:
            if rank <= rows:
                break
            rank -= rows
        if rows <= BUCKET_ROWS or len(prefix) >= 30:
            break
        counts = _counts(places, prefix)
    bucket = places.filter(F.col("place").startswith(prefix)).orderBy("place", "row_id")
    found = bucket.offset(rank - 1).limit(1).first()
    return found["place"], found["row_id"]


def _up_to(cut: tuple[str, int] | None) -> Column:
    if cut is None:
        return F.lit(False)
    place, last_id = cut
    return (F.col("_place") < place) | (
        (F.col("_place") == place) & (F.col("_split_id") <= F.lit(last_id))
    )


def split_rows(
    df: DataFrame,
    ratios: Sequence[float] = RATIOS,
    seed: int = 42,
    exact: bool = True,
    row_id: str = "row_id",
) -> DataFrame:
    """Add ``split``: train, validate or test.

    Exact sizes need three scans of the ids only; ``exact=False`` cuts the md5 range itself and
    needs none, with sizes that are right on average.
    """
    placed = df.withColumn("_place", shuffle_place(row_id, seed)).withColumn(
        "_split_id", as_col(row_id)
    )
    if exact:
        places = df.select(
            shuffle_place(row_id, seed).alias("place"), as_col(row_id).alias("row_id")
        )
        counts = _counts(places)
        train, validate = split_targets(sum(n for _, n in counts), ratios)
        first = _place_of_rank(places, counts, train)
        second = _place_of_rank(places, counts, train + validate)
        in_train, in_validate = _up_to(first), _up_to(second)
    else:
        in_train = F.col("_place") < f"{int(ratios[0] * 16**8):08x}"
        in_validate = F.col("_place") < f"{int((ratios[0] + ratios[1]) * 16**8):08x}"
    label = F.when(in_train, "train").when(in_validate, "validate").otherwise("test")
    return placed.withColumn("split", label).drop("_place", "_split_id")


def split_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("split").agg(F.count(F.lit(1)).alias("rows"))
