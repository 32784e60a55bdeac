"""Empty values, pattern validation, number coercion, and the statistics around cleaning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import duck, query, table
from checks.inputs import RULES, cell_patches, messy_customers
from checks.patches import PATCHED_CELLS
from sparkscour.functions.validity import is_empty, leading_number
from sparkscour.operators.columns import coerce_numeric, rename_by_contract
from sparkscour.operators.patches import apply_cell_patches
from sparkscour.operators.validation import (
    column_outcomes,
    significant_improvements,
    split_valid_invalid,
    validation_stats,
    validation_summary,
)
from sparkscour.plans.preclean import preclean
from sparkscour.session import durable


def named_customers(spark, d) -> DataFrame:
    """The stored result of the text cleaning, as the later stages read it."""
    return durable(rename_by_contract(preclean(messy_customers(spark, d)), RULES))


EMPTY_COLUMNS = ("phone", "balance", "signup", "email")
MODES = ("validator", "cleaner", "unified")


@query(
    "empty_predicate_modes",
    f"WITH {duck.CLEANED} SELECT row_id, "
    + ", ".join(f"{duck.empty(c, m)} AS {c}_{m}" for c in EMPTY_COLUMNS for m in MODES)
    + " FROM named",
)
def empty_predicate_modes(spark, d):
    cells = [is_empty(c, m).alias(f"{c}_{m}") for c in EMPTY_COLUMNS for m in MODES]
    return named_customers(spark, d).select("row_id", *cells)


@query("invalid_cells", f"WITH {duck.CLEANED} {duck.invalid_sql('named', 'cleaner')}")
def invalid(spark, d):
    return split_valid_invalid(named_customers(spark, d), RULES, "cleaner")[1]


@query(
    "valid_cells",
    f"WITH {duck.CLEANED} "
    + " UNION ALL ".join(
        f"SELECT row_id, '{r.name}' AS \"column\", CASE WHEN {duck.empty(chr(34) + r.name + chr(34), 'cleaner')} "
        f"THEN '' ELSE \"{r.name}\" END AS value FROM named "
        f"WHERE NOT {duck.bad(chr(34) + r.name + chr(34), r.regex, 'cleaner')}"
        for r in duck.CHECKED
    ),
)
def valid(spark, d):
    return split_valid_invalid(named_customers(spark, d), RULES, "cleaner")[0]


@query("validation_stats", f"WITH {duck.CLEANED} {duck.stats_sql('named')}")
def stats(spark, d):
    return validation_stats(named_customers(spark, d), RULES)


def _outcome_sql() -> str:
    parts = []
    for r in RULES:
        n = f"count(*) FILTER ({duck.bad(chr(34) + r.name + chr(34), r.regex, 'cleaner')})"
        if r.is_excluded:
            outcome, n = "'excluded'", "count(*) * 0"
        elif r.regex == "^.*$":
            outcome, n = "'skipped'", "count(*) * 0"
        else:
            outcome = f"CASE WHEN {n} > 0 THEN 'cleaned' ELSE 'already valid' END"
        parts.append(
            f"SELECT {r.index} AS index, '{r.name}' AS \"column\", {outcome} AS outcome, "
            f"{n} AS invalid_count FROM named"
        )
    return f"WITH {duck.CLEANED} " + " UNION ALL ".join(parts)


@query("column_outcomes", _outcome_sql())
def outcomes(spark, d):
    return column_outcomes(named_customers(spark, d), RULES)


_BEFORE_AFTER = (
    f"WITH {duck.CLEANED}, {PATCHED_CELLS}, b AS ({duck.stats_sql('named')}), "
    f"a AS ({duck.stats_sql('patched')})"
)


def _before_after(spark, d):
    before = named_customers(spark, d)
    after = apply_cell_patches(before, cell_patches(spark, d))
    return validation_stats(before, RULES), validation_stats(after, RULES)


@query(
    "validation_summary",
    f"""{_BEFORE_AFTER}, s AS (SELECT count(*) AS columns, CAST(sum(b.total_count) AS BIGINT) AS data_points,
    CAST(sum(b.valid_count) AS BIGINT) AS valid_before, CAST(sum(b.invalid_count) AS BIGINT) AS invalid_before,
    CAST(sum(a.valid_count) AS BIGINT) AS valid_after, CAST(sum(a.invalid_count) AS BIGINT) AS invalid_after
    FROM b JOIN a USING ("column"))
    SELECT *, {duck.pct('valid_before', 'data_points')} AS valid_before_pct,
    {duck.pct('valid_after', 'data_points')} AS valid_after_pct,
    round({duck.pct('valid_after', 'data_points')} - {duck.pct('valid_before', 'data_points')}, 2)
      AS improvement FROM s""",
)
def summary(spark, d):
    return validation_summary(*_before_after(spark, d))


@query(
    "significant_improvements",
    f"""{_BEFORE_AFTER} SELECT b."column", round(a.valid_pct - b.valid_pct, 2) AS improvement
    FROM b JOIN a USING ("column") WHERE round(a.valid_pct - b.valid_pct, 2) >= 5""",
)
def improvements(spark, d):
    return significant_improvements(*_before_after(spark, d))


_NUMBER = r"'^\s*([+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?)', 1"


def number_sql(x: str) -> str:
    return f"coalesce(TRY_CAST(nullif(regexp_extract({x}, {_NUMBER}), '') AS DOUBLE), 0.0)"


@query(
    "numeric_coerce",
    f"WITH {duck.CLEANED} SELECT row_id, {number_sql('balance')} AS balance, "
    f"{number_sql('phone')} AS phone, signup FROM named",
)
def numeric(spark, d):
    cleaned = named_customers(spark, d).select("row_id", "balance", "phone", "signup")
    return coerce_numeric(cleaned, ["balance", "phone"])


@query(
    "numeric_coerce_events",
    f"SELECT event_id, {number_sql('props')} AS props_number, "
    f"{number_sql('substring(props, 7)')} AS k_number FROM events",
)
def numeric_events(spark, d):
    return table(spark, d, "events").select(
        "event_id",
        leading_number("props").alias("props_number"),
        leading_number(F.expr("substring(props, 7)")).alias("k_number"),
    )
