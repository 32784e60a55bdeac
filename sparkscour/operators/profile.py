"""A contract proposed from the data: type, pattern and flags of each column from one profile."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col
from sparkscour.functions.validity import ANY_VALUE, is_empty
from sparkscour.operators.patterns import induced_patterns

# Patterns of the recognized types, most specific first.
TYPE_PATTERNS = {
    "int": r"^[+-]?[0-9]+$",
    "float": r"^[+-]?[0-9]+\.[0-9]+$",
    "date": r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$",
    "email": r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$",
}
TYPE_SHARE = 0.95


# An estimate of distinct values at least this share of the filled cells is counted exactly.
NEAR_UNIQUE = 0.8


def _filled(name: str) -> Column:
    text = as_col(name).cast("string")
    return F.when(~is_empty(text, "unified"), text)


def _distinct_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct filled cells per column: estimated, and exact where the estimate is near all of them."""
    first = df.agg(
        *[F.count(_filled(c)).alias(f"n{i}") for i, c in enumerate(columns)],
        *[F.approx_count_distinct(_filled(c)).alias(f"d{i}") for i, c in enumerate(columns)],
    ).first()
    counts = {c: first[f"d{i}"] for i, c in enumerate(columns)}
    for i, column in enumerate(columns):
        if first[f"d{i}"] >= NEAR_UNIQUE * first[f"n{i}"]:
            once = df.select(_filled(column).alias("value")).groupBy("value").count()
            counts[column] = once.filter("value IS NOT NULL").count()
    return counts


def profile_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Counts, empties, distinct values, type counts, lengths and smallest value per column.

    One aggregation over one scan, after one for estimates of distinct values; a column that may be
    unique is counted exactly, by values combined before the shuffle.
    """
    distinct = _distinct_counts(df, columns)
    measures, rows = [F.count(F.lit(1)).alias("total")], []
    for i, name in enumerate(columns):
        value = _filled(name)
        measures += [
            F.count(value).alias(f"filled{i}"),
            F.lit(distinct[name]).cast("long").alias(f"distinct{i}"),
            F.count_if(value.rlike("[0-9]")).alias(f"digits{i}"),
            F.coalesce(F.min(F.length(value)), F.lit(0)).alias(f"shortest{i}"),
            F.coalesce(F.max(F.length(value)), F.lit(0)).alias(f"longest{i}"),
            F.coalesce(F.min(value), F.lit("")).alias(f"example{i}"),
            *[
                F.count_if(value.rlike(p.replace("$", r"\z"))).alias(f"{t}{i}")
                for t, p in TYPE_PATTERNS.items()
            ],
        ]
        rows.append(
            F.struct(
                F.lit(name).alias("original_name"),
                F.lit(i + 1).alias("index"),
                F.col("total").alias("total_count"),
                (F.col("total") - F.col(f"filled{i}")).alias("empty_count"),
                F.col(f"distinct{i}").alias("distinct_count"),
                F.col(f"shortest{i}").alias("shortest"),
                F.col(f"longest{i}").alias("longest"),
                F.col(f"digits{i}").alias("digit_count"),
                F.col(f"example{i}").alias("example"),
                *[F.col(f"{t}{i}").alias(f"{t}_count") for t in TYPE_PATTERNS],
            )
        )
    return df.agg(*measures).select(F.inline(F.array(*rows)))


def contract_name(c: Column) -> Column:
    """Header as a contract name: lower case words joined by underscores."""
    return F.btrim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def contract_from_profile(profile: DataFrame, type_share: float = TYPE_SHARE) -> DataFrame:
    """Contract rows: the type that at least ``type_share`` of the filled cells have.

    A float column may hold integers too. A column without such a type is text with the
    catch-all pattern, one without any value is excluded. A column whose filled cells are all
    different is proposed as unique if it holds words: unique columns are compared by likeness, and
    different numbers, dates and codes are alike.
    """
    filled = F.col("total_count") - F.col("empty_count")
    enough = filled * F.lit(type_share)
    has_values = filled > 0
    is_int = has_values & (F.col("int_count") >= enough)
    is_float = has_values & (F.col("int_count") + F.col("float_count") >= enough)
    is_date = has_values & (F.col("date_count") >= enough)
    is_mail = has_values & (F.col("email_count") >= enough)
    kind = (
        F.when(is_int, "int").when(is_float, "float").when(is_date, "date").when(is_mail, "email")
    ).otherwise("string")
    pattern = (
        F.when(is_int, TYPE_PATTERNS["int"])
        .when(is_float, r"^[+-]?[0-9]+(\.[0-9]+)?$")
        .when(is_date, TYPE_PATTERNS["date"])
        .when(is_mail, TYPE_PATTERNS["email"])
        .otherwise(ANY_VALUE)
    )
    unique = has_values & (F.col("distinct_count") == filled) & (F.col("digit_count") < enough)
    return profile.select(
        "original_name",
        contract_name(F.col("original_name")).alias("name"),
        (~has_values).alias("is_excluded"),
        unique.alias("is_unique"),
        "index",
        kind.alias("data_type"),
        F.concat_ws(
            " ",
            filled.cast("string"),
            F.lit("values of"),
            F.col("shortest").cast("string"),
            F.lit("to"),
            F.col("longest").cast("string"),
            F.lit("characters"),
        ).alias("description"),
        "example",
        pattern.alias("regex"),
    )


def propose_contract(df: DataFrame, columns: Sequence[str], learn_patterns: bool = False) -> DataFrame:
    """A contract from one profile; with ``learn_patterns``, text columns get a pattern where one is found."""
    contract = contract_from_profile(profile_columns(df, columns))
    if not learn_patterns:
        return contract
    # One row per column of the table.
    learned = induced_patterns(df, columns).select("original_name", F.col("regex").alias("_learned"))
    open_text = (F.col("data_type") == "string") & F.col("_learned").isNotNull()
    joined = contract.join(learned, "original_name", "left")
    return joined.withColumn("regex", F.when(open_text, F.col("_learned")).otherwise(F.col("regex"))).select(*contract.columns)
