"""Registered queries: each runs library operators on the given tables, next to SQL for DuckDB."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from sparkscour.session import checkpoint_folder

Build = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Build] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    def add(build: Build) -> Build:
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, where all executors can write."""
    return f"{checkpoint_folder(spark)}/scratch-{uuid.uuid4().hex}"


def load_all() -> None:
    from checks import contracts, duplicates, patches, rules, splitting, text, validation  # noqa: F401
