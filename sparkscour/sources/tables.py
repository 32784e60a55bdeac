"""Table reader and writer."""

from __future__ import annotations

import posixpath
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.sources.csv_ranges import read_csv_ranges


CSV_OPTIONS = {"quote": '"', "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
UNITS = {"": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}


def read_table(
    spark: SparkSession,
    path: str,
    fmt: str = "csv",
    multi_line: bool = True,
    with_position: bool = False,
    ranges: bool | None = None,
) -> DataFrame:
    """Read a table; CSV columns are all strings named by the header, blank lines are skipped.

    With ``multi_line`` cells may have line breaks inside quotes. Spark reads such a file in one task;
    where a file is larger than a task's share (``spark.sql.files.maxPartitionBytes``), or with
    ``ranges=True``, its ranges are read side by side instead (``sources.csv_ranges``). Pass ``False``
    where no cell has a line break, which saves a scan. ``with_position`` adds ``_file``, ``_block`` and
    ``_pos``, whose order is the order of the rows in the files (see ``operators.rows.with_row_id``).
    """
    if fmt == "csv":
        df = spark.read.csv(path, header=True, inferSchema=False, multiLine=multi_line, **CSV_OPTIONS)
        if multi_line and (_has_large_file(spark, path) if ranges is None else ranges):
            df = read_csv_ranges(spark, path, df.columns, {**CSV_OPTIONS, "multiLine": True})
            return df if with_position else df.drop("_file", "_block", "_pos")
    elif fmt == "parquet":
        df = spark.read.parquet(path)
    else:
        raise ValueError(f"unknown table format: {fmt}")
    if with_position:
        df = df.select(
            "*",
            F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_block"),
            F.monotonically_increasing_id().alias("_pos"),
        )
    return df


def _has_large_file(spark: SparkSession, path: str) -> bool:
    """Whether a file is larger than a task's share; folders with partition columns are left to Spark."""
    files = spark.read.format("binaryFile").load(path)
    if set(files.columns) - {"path", "modificationTime", "length", "content"}:
        return False
    number, unit = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get("spark.sql.files.maxPartitionBytes").lower()).groups()
    return not files.filter(F.col("length") > int(number) * UNITS[unit]).select("length").isEmpty()


def _plain(path: str) -> str:
    return posixpath.normpath(re.sub(r"^file:/+", "/", path))


def write_table(
    df: DataFrame,
    path: str,
    fmt: str = "csv",
    source_path: str | None = None,
    mode: str = "errorifexists",
    partition_by: list[str] | None = None,
) -> None:
    """Write a table; refuses to overwrite ``source_path``, the table it came from."""
    if source_path is not None and _plain(path) == _plain(source_path):
        raise ValueError(f"cannot overwrite the input table: {path}")
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.csv(
            path,
            header=True,
            quote='"',
            escape='"',
            nullValue="",
            emptyValue="",
            ignoreLeadingWhiteSpace=False,
            ignoreTrailingWhiteSpace=False,
        )
    elif fmt == "parquet":
        writer.parquet(path)
    else:
        raise ValueError(f"unknown table format: {fmt}")


def write_splits(df: DataFrame, path: str, fmt: str = "csv", mode: str = "errorifexists") -> None:
    """Write ``split=train|validate|test`` folders in one pass; an empty split writes nothing."""
    write_table(df, path, fmt, mode=mode, partition_by=["split"])
