"""Column contracts as DataFrames and as JSON keyed by the original header."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CONTRACT_SCHEMA = (
    "original_name string, name string, is_excluded boolean, is_unique boolean, index int, "
    "data_type string, description string, example string, regex string"
)
# Field names of the JSON form.
JSON_SCHEMA = (
    "map<string, struct<name: string, isExcluded: boolean, unique: boolean, index: int, "
    "dataType: string, description: string, example: string, regex: string>>"
)
# A contract has one row per table column; more than this is not a contract.
MAX_RULES = 20_000


@dataclass(frozen=True)
class ColumnRule:
    original_name: str
    name: str
    is_excluded: bool = False
    is_unique: bool = False
    index: int = 0
    data_type: str = ""
    description: str = ""
    example: str = ""
    regex: str = ""


Contract = DataFrame | Sequence[ColumnRule]


def rules_of(contract: Contract) -> list[ColumnRule]:
    """The rules of a contract in index order (one per table column, so they fit the driver)."""
    if isinstance(contract, DataFrame):
        rows = contract.select(*[f.split()[0] for f in CONTRACT_SCHEMA.split(", ")])
        found = [ColumnRule(**r.asDict()) for r in rows.limit(MAX_RULES + 1).collect()]
    else:
        found = list(contract)
    if len(found) > MAX_RULES:
        raise ValueError(f"a contract cannot have more than {MAX_RULES} columns")
    return sorted(found, key=lambda r: (r.index, r.original_name))


def contract_frame(spark: SparkSession, rules: Sequence[ColumnRule]) -> DataFrame:
    rows = [tuple(vars(r).values()) for r in rules]
    return spark.createDataFrame(rows, CONTRACT_SCHEMA)


def contract_from_json(docs: DataFrame, text: Column | str, *keep: str) -> DataFrame:
    """Explode contract JSON into contract rows; ``keep`` columns are carried along."""
    entries = F.from_json(text, JSON_SCHEMA)
    return docs.select(*keep, F.explode(entries).alias("original_name", "e")).select(
        *keep,
        "original_name",
        F.col("e.name").alias("name"),
        F.coalesce("e.isExcluded", F.lit(False)).alias("is_excluded"),
        F.coalesce("e.unique", F.lit(False)).alias("is_unique"),
        F.col("e.index").alias("index"),
        F.col("e.dataType").alias("data_type"),
        F.col("e.description").alias("description"),
        F.col("e.example").alias("example"),
        F.col("e.regex").alias("regex"),
    )


def contract_to_json(contract: DataFrame, *by: str) -> DataFrame:
    """One JSON document per ``by`` value (one in all without ``by``), entries in index order.

    A document holds one entry per table column, so a group is as small as a table is narrow.
    """
    entry = F.struct(
        "index",
        "original_name",
        F.struct(
            F.col("name"),
            F.col("is_excluded").alias("isExcluded"),
            F.col("is_unique").alias("unique"),
            F.col("index"),
            F.col("data_type").alias("dataType"),
            F.col("description"),
            F.col("example"),
            F.col("regex"),
        ).alias("rule"),
    )
    entries = F.transform(
        F.sort_array(F.collect_list(entry)),
        lambda e: F.struct(e["original_name"].alias("key"), e["rule"].alias("value")),
    )
    return contract.groupBy(*by).agg(F.to_json(F.map_from_entries(entries)).alias("json"))


def read_contract(spark: SparkSession, path: str) -> DataFrame:
    return contract_from_json(spark.read.text(path, wholetext=True), "value")


def write_contract(contract: DataFrame, path: str, mode: str = "errorifexists") -> None:
    contract_to_json(contract).coalesce(1).write.mode(mode).text(path)


def active_columns(contract: DataFrame, types: Sequence[str] | None = None) -> DataFrame:
    """Rules that take part in cleaning, in index order; ``types`` keeps some data types only."""
    active = contract.filter(~F.col("is_excluded"))
    if types is not None:
        active = active.filter(F.col("data_type").isin(*types))
    return active.orderBy("index")


def unique_columns(contract: DataFrame) -> DataFrame:
    """Rules of the columns that form the comparison key; excluded columns may be among them."""
    return contract.filter("is_unique").orderBy("index")


def active_rules(contract: Contract, types: Sequence[str] | None = None) -> list[ColumnRule]:
    return [
        r
        for r in rules_of(contract)
        if not r.is_excluded and (types is None or r.data_type in types)
    ]
