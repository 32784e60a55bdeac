"""Small column helpers shared by the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters that separate words, fixed by the operators' contracts: x20 and x09 to x0D.
SPACES = r"[\x20\x09-\x0D]+"


def name(column: str) -> Column:
    """A column by its exact name, dots included."""
    return F.col("`" + column.replace("`", "``") + "`")


def text_of(df: DataFrame, text: str = "text") -> Column:
    """The text with null as the empty text."""
    return F.coalesce(name(text).cast("string"), F.lit(""))


def words_of(text: Column) -> Column:
    """The words of a text as an array; none for null."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACES), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once per row, also inside lambdas of ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def let_all(values: dict[str, Column], body: Callable[[Column], Column]) -> Column:
    """Like ``let`` for several values, given to ``body`` as one struct."""
    return let(F.struct(*[v.alias(k) for k, v in values.items()]), body)


def packed(df: DataFrame) -> Column:
    """All columns as one struct, so that working columns can't clash with them."""
    return F.struct(*[name(c) for c in df.columns])


def unpacked(df: DataFrame, row: str, columns: list[str]) -> DataFrame:
    return df.select(*[name(row).getField(c).alias(c) for c in columns])
