"""Exclusion lists: one column name per line."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, trim_space


def parse_exclusions(lines: DataFrame, line: Column | str = "value") -> DataFrame:
    """Distinct trimmed names; blank lines and ``#`` comments are skipped."""
    name = trim_space(as_col(line))
    return (
        lines.select(name.alias("column"))
        .filter((F.col("column") != "") & ~F.col("column").startswith("#"))
        .distinct()
    )


def read_exclusions(spark: SparkSession, path: str | None) -> DataFrame:
    """Read an exclusion list; a missing file is an empty list."""
    none = spark.createDataFrame([], "column string")
    if not path:
        return none
    try:
        return parse_exclusions(spark.read.text(path))
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return none
        raise
