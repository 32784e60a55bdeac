"""Reply texts: one file per column, or per batch of a column."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def reply_column(file_name: Column) -> Column:
    """Column name of a reply file: its name without the output and batch suffixes."""
    stem = F.regexp_replace(file_name, r"_output\.txt", "")
    return F.regexp_replace(stem, r"_batch_\d+$", "")


def read_replies(spark: SparkSession, folder: str) -> DataFrame:
    """``source`` (file name), ``column`` and ``text`` of each reply in a folder."""
    files = spark.read.text(folder, wholetext=True, pathGlobFilter="*_output.txt")
    # Spark reports the name as in a URI; a plus sign there is just a plus sign.
    name = F.url_decode(F.replace(F.col("_metadata.file_name"), F.lit("+"), F.lit("%2B")))
    return files.select(
        name.alias("source"), reply_column(name).alias("column"), F.col("value").alias("text")
    )
