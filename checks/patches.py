"""Corrections parsed from replies, applied to tables, and logged."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck, query, table
from checks.inputs import CELL_PATCHES_SQL, NAMES, ROW_PATCHES_SQL, RULES, cell_patches, row_patches
from sparkscour.operators.patches import (
    apply_cell_patches,
    apply_row_patches,
    build_change_log,
    change_summary,
    change_totals,
    flag_unresolved,
    latest_cell_patches,
    latest_row_patches,
)
from sparkscour.operators.reply_text import (
    parse_cell_patches,
    parse_row_patches,
    scope_row_patches,
)
from sparkscour.operators.validation import invalid_cells
from sparkscour.plans.preclean import preclean
from sparkscour.plans.stitch import stitch
from sparkscour.session import durable

# Replies with corrections: one per nation of suppliers, one line or two per supplier.
QUOTED = 'Name, ""new""'
_QUOTED_SQL = duck.lit(f'"{QUOTED}",')


def _replies(spark, d):
    key = F.col("s_suppkey").cast("string")
    lines = F.array(
        F.concat(key, F.lit(f',"{QUOTED}",'), "s_name", F.lit(",,")),
        F.when(
            F.col("s_suppkey") % 3 == 0,
            F.concat(F.lit("```FLAGGED: odd```  "), key, F.lit(",flagged "), key),
        ),
        F.when(F.col("s_suppkey") % 5 == 0, F.lit("... Existing Data ...")),
        F.when(F.col("s_suppkey") % 7 == 0, F.lit("  … Existing Data …  ")),
        F.when(F.col("s_suppkey") % 2 == 0, F.concat(F.lit("no id,"), key)),
        F.lit("   "),
    )
    # A reply lists the corrections of at most ten suppliers.
    text = F.array_join(
        F.flatten(
            F.transform(
                F.array_sort(F.collect_list(F.struct("s_suppkey", F.array_compact(lines).alias("l")))),
                lambda e: e["l"],
            )
        ),
        "\n",
    )
    return (
        table(spark, d, "supplier")
        .groupBy(F.expr("(s_suppkey - s_suppkey % 10) / 10").cast("long").alias("reply_id"))
        .agg(F.concat(F.lit("ok\n<semantic_diff>\n"), text, F.lit("\n</semantic_diff>")).alias("text"))
        .withColumn("column", F.lit("name"))
        .withColumn("source", F.concat(F.lit("name_batch_"), "reply_id"))
    )


# Every supplier has these lines, in this order; ``place`` is the line number in the reply.
_LINES_SQL = """
lines AS (
  SELECT s_suppkey, s_name, CAST((s_suppkey - s_suppkey % 10) / 10 AS BIGINT) AS reply_id, kind,
    CAST(row_number() OVER (PARTITION BY CAST((s_suppkey - s_suppkey % 10) / 10 AS BIGINT)
                            ORDER BY s_suppkey, kind) AS BIGINT) AS seq
  FROM supplier, (SELECT unnest([1, 2, 3, 4, 5, 6]) AS kind)
  WHERE kind IN (1, 6) OR (kind = 2 AND s_suppkey % 3 = 0) OR (kind = 3 AND s_suppkey % 5 = 0)
    OR (kind = 4 AND s_suppkey % 7 = 0) OR (kind = 5 AND s_suppkey % 2 = 0))
"""


@query(
    "row_patches_parse",
    f"""WITH {_LINES_SQL}
    SELECT reply_id, s_suppkey AS row_id, CASE kind WHEN 1 THEN ['Name, "new"', s_name, '', '']
      ELSE ['flagged ' || s_suppkey] END AS "values", kind = 2 AS flagged, seq
    FROM lines WHERE kind IN (1, 2)""",
)
def row_patches_parse(spark, d):
    return parse_row_patches(_replies(spark, d))


@query(
    "cell_patches_parse",
    f"""WITH {_LINES_SQL}
    SELECT s_suppkey AS row_id, 'name' AS "column", {_QUOTED_SQL} || s_name || ',,' AS corrected_value,
      'name_batch_' || reply_id AS source, seq FROM lines WHERE kind = 1""",
)
def cell_patches_parse(spark, d):
    return parse_cell_patches(_replies(spark, d))


@query(
    "scope_patches",
    f"""WITH {_LINES_SQL}
    SELECT reply_id, seq, CASE WHEN kind = 1 THEN CAST(s_suppkey AS VARCHAR) ELSE 'no id' END AS id,
      CASE WHEN kind = 1 THEN 'Name, "new"' ELSE CAST(s_suppkey AS VARCHAR) END AS value
    FROM lines WHERE kind IN (1, 5)""",
)
def scope_patches(spark, d):
    return scope_row_patches(_replies(spark, d), 1)


# Row patches and cell patches on whole tables.
_LAST_ROW = f"""rp AS ({ROW_PATCHES_SQL}),
last_row AS (SELECT row_id, arg_max("values", seq) AS v FROM rp GROUP BY row_id)"""
_LAST_CELL = f"""cp AS ({CELL_PATCHES_SQL}),
last_cell AS (SELECT row_id, "column", corrected_value FROM cp
  QUALIFY row_number() OVER (PARTITION BY row_id, "column" ORDER BY source DESC, seq DESC) = 1)"""


def _cells_onto(source: str) -> str:
    picks = ", ".join(
        f"""coalesce(max(corrected_value) FILTER (p."column" = '{n}'), any_value("{n}")) AS "{n}" """
        for n in NAMES
    )
    return (
        f"SELECT s.row_id, {picks} FROM {source} s LEFT JOIN last_cell p ON p.row_id = s.row_id "
        "GROUP BY s.row_id"
    )


def _rows_onto(source: str) -> str:
    picks = ", ".join(
        f'CASE WHEN len(v) >= {i} THEN v[{i}] ELSE "{n}" END AS "{n}"'
        for i, n in enumerate(NAMES, start=1)
    )
    return f"SELECT s.row_id, {picks} FROM {source} s LEFT JOIN last_row p ON p.row_id = s.row_id"


PATCHED_CELLS = f"{_LAST_CELL}, patched AS ({_cells_onto('named')})"


def _named(spark, d):
    from checks.validation import named_customers

    return named_customers(spark, d)


@query(
    "latest_patches",
    f"""WITH {_LAST_ROW}, {_LAST_CELL}
    SELECT row_id, "column", corrected_value, CAST(NULL AS VARCHAR[]) AS "values" FROM last_cell
    UNION ALL SELECT row_id, NULL, NULL, v FROM last_row""",
)
def latest_patches(spark, d):
    cells = latest_cell_patches(cell_patches(spark, d))
    rows = latest_row_patches(row_patches(spark, d))
    return cells.unionByName(rows, allowMissingColumns=True)


@query("apply_row_patches", f"WITH {duck.CLEANED}, {_LAST_ROW} {_rows_onto('named')}")
def row_patched(spark, d):
    return apply_row_patches(_named(spark, d), row_patches(spark, d))


@query("apply_cell_patches", f"WITH {duck.CLEANED}, {PATCHED_CELLS} SELECT * FROM patched")
def cell_patched(spark, d):
    return apply_cell_patches(_named(spark, d), cell_patches(spark, d))


def _log_sql(source: str) -> str:
    original = "CASE c.\"column\" " + " ".join(
        f"WHEN '{n}' THEN s.\"{n}\"" for n in NAMES
    ) + " END"
    known = ", ".join(f"'{n}'" for n in NAMES)
    return f"""SELECT c.row_id, c."column", c.source, CAST(c.seq AS BIGINT) AS seq,
      coalesce(lag(c.corrected_value) OVER w, {original}, '') AS current_value, c.corrected_value
    FROM cp c JOIN {source} s ON s.row_id = c.row_id WHERE c."column" IN ({known})
    WINDOW w AS (PARTITION BY c.row_id, c."column" ORDER BY c.source, c.seq)"""


def _flags_sql(patched: str) -> str:
    regex = "CASE i.\"column\" " + " ".join(
        f"WHEN '{r.name}' THEN {duck.lit(r.regex)}" for r in RULES
    ) + " END"
    reason = f"concat('Value ''', i.value, ''' does not match regex: ', {regex})"
    return f"""entries AS (SELECT *, current_value <> corrected_value AS needs_change FROM log),
    bad AS ({duck.invalid_sql(patched)}),
    flagged AS (
      SELECT e.row_id, e."column", e.source, e.seq, e.current_value, e.corrected_value,
        e.needs_change, i.row_id IS NOT NULL AS is_flagged,
        CASE WHEN i.row_id IS NULL THEN '' ELSE {reason} END AS flag_reason,
        i.row_id IS NOT NULL AS unable_to_fix
      FROM entries e LEFT JOIN bad i ON i.row_id = e.row_id AND i."column" = e."column"
      UNION ALL
      SELECT i.row_id, i."column", 'N/A (Regex Validation)', 0, i.value, i.value, FALSE, TRUE,
        {reason}, TRUE
      FROM bad i WHERE NOT EXISTS (
        SELECT 1 FROM entries e WHERE e.row_id = i.row_id AND e."column" = i."column")),
    final AS (SELECT *, CASE WHEN is_flagged THEN 'FLAGGED' WHEN needs_change THEN 'CHANGED'
      ELSE 'VALID' END AS status FROM flagged)"""


_CHANGES = (
    f"WITH {duck.CLEANED}, {PATCHED_CELLS}, log AS ({_log_sql('named')}), {_flags_sql('patched')}"
)


def _changes(spark, d):
    named = _named(spark, d)
    patches = cell_patches(spark, d)
    failing = invalid_cells(apply_cell_patches(named, patches), RULES)
    return flag_unresolved(build_change_log(named, patches), failing, RULES, patches)


@query("change_log", f"{_CHANGES} SELECT * FROM final")
def change_log(spark, d):
    return _changes(spark, d)


@query(
    "change_summary",
    f"""{_CHANGES} SELECT "column", count(*) AS entries, count(*) FILTER (needs_change) AS applied,
    count(*) FILTER (is_flagged) AS flagged FROM final GROUP BY "column" """,
)
def summary(spark, d):
    return change_summary(_changes(spark, d))


@query(
    "change_totals",
    f"""{_CHANGES} SELECT count(DISTINCT "column") AS columns, count(*) AS entries,
    count(*) FILTER (needs_change) AS applied, count(*) FILTER (is_flagged) AS flagged,
    {duck.pct('count(*) FILTER (is_flagged)', 'count(*)')} AS flagged_pct FROM final""",
)
def totals(spark, d):
    return change_totals(_changes(spark, d))


STITCH_SQL = (
    f"WITH {duck.CLEANED}, {_LAST_ROW}, {_LAST_CELL}, fixed AS ({_rows_onto('named')}), "
    f"patched AS ({_cells_onto('fixed')})"
)


def _stitched(spark, d):
    from checks.inputs import messy_customers

    cleaned = durable(preclean(messy_customers(spark, d)))
    return stitch(cleaned, RULES, row_patches(spark, d), cell_patches(spark, d))


@query("stitch", f"{STITCH_SQL} SELECT * FROM patched")
def stitched(spark, d):
    return _stitched(spark, d).table


@query("stitch_stats_before", f"{STITCH_SQL} {duck.stats_sql('fixed')}")
def stitched_before(spark, d):
    return _stitched(spark, d).before


@query(
    "status_report",
    f"""{STITCH_SQL}, log AS ({_log_sql('fixed')}), {_flags_sql('patched')},
    stats AS ({duck.stats_sql('patched')})
    SELECT f.*, s.valid_pct, s.invalid_count FROM final f LEFT JOIN stats s ON s."column" = f."column" """,
)
def report(spark, d):
    return _stitched(spark, d).report()
