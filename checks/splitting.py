"""Token batches and correctors, isolation forest, splits, and the full run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import duck, query, scratch, table
from checks.duplicates import GROUPS_SQL
from checks.inputs import MESSY, NEAR, RULES, cell_patches, messy_customers, row_patches
from checks.patches import STITCH_SQL
from checks.rules import DATE, PHONE
from checks.validation import named_customers, number_sql
from sparkscour.functions import standardize as S
from sparkscour.operators.batches import ask_corrector, correct_cells, plan_batches
from sparkscour.operators.outliers import (
    NODE_SCHEMA,
    drop_outliers,
    iforest_fit,
    iforest_score,
    mean_path,
    outlier_report,
)
from sparkscour.operators.rows import with_row_id
from sparkscour.operators.split import split_rows, split_sizes
from sparkscour.operators.validation import split_valid_invalid
from sparkscour.plans.isosplit import iso_split
from sparkscour.plans.run import RunConfig, run
from sparkscour.sources.contracts import ColumnRule
from sparkscour.sources.exclusions import parse_exclusions
from sparkscour.streaming.clean import clean_stream, write_available

LIMIT = 20_000


@query(
    "token_batches",
    f"""WITH c AS (SELECT doc_id AS row_id, source AS "column", text AS value,
      length(concat(doc_id, ',', {duck.csv('text')})) + 1 AS chars FROM documents),
    r AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS rank,
      count(*) OVER (PARTITION BY "column") AS n FROM c),
    heads AS (SELECT "column", n, k, sum(chars) FILTER (rank <= ceil(n / k)) AS chars
      FROM r, (SELECT unnest(range(1, 21)) AS k) GROUP BY ALL),
    tries AS (SELECT "column", n, k,
      ceil((31 + length(concat('ID,', "column")) + chars) / 4.0) + 2000 AS tokens FROM heads),
    plan AS (SELECT "column", n, coalesce(min(k) FILTER (tokens <= {LIMIT}), 20) AS batches
      FROM tries GROUP BY ALL)
    SELECT row_id, r."column", value, CAST(ceil(rank / ceil(r.n / batches)) AS INT) AS batch,
      CAST(batches AS INT) AS batches FROM r JOIN plan USING ("column")""",
)
def token_batches(spark, d):
    cells = table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("column"), F.col("text").alias("value")
    )
    return plan_batches(cells, token_limit=LIMIT, max_batches=20)


@query(
    "token_batches_all_fit",
    f"""WITH c AS (SELECT doc_id AS row_id, source AS "column", text AS value,
      length(concat(doc_id, ',', {duck.csv('text')})) + 1 AS chars,
      4 * ({LIMIT} - 2000) - 31 - length(concat('ID,', source)) AS room FROM documents),
    r AS (SELECT *, row_number() OVER w AS rank, sum(chars) OVER w AS upto FROM c
      WINDOW w AS (PARTITION BY "column" ORDER BY row_id)),
    sizes AS (SELECT "column", count(*) AS n, sum(chars) AS total, max(chars) AS longest,
      greatest(count(*) FILTER (upto <= room), 1) AS fitting, any_value(room) AS room FROM r GROUP BY ALL),
    plan AS (SELECT *, CASE WHEN total <= room THEN 1 ELSE greatest(ceil(n / fitting), 2) END AS k FROM sizes),
    dealt AS (SELECT r.*, longest, ceil(rank / ceil(n / k)) AS b FROM r JOIN plan USING ("column")),
    parts AS (SELECT *, CASE WHEN sum(chars) OVER w > room
      THEN floor((upto - chars - min(upto - chars) OVER w) / greatest(room - longest, 1)) ELSE 0 END AS part
      FROM dealt WINDOW w AS (PARTITION BY "column", b)),
    ranked AS (SELECT *, dense_rank() OVER (PARTITION BY "column" ORDER BY b, part) AS batch FROM parts)
    SELECT row_id, "column", value, CAST(batch AS INT) AS batch,
      CAST(max(batch) OVER (PARTITION BY "column") AS INT) AS batches FROM ranked""",
)
def token_batches_all_fit(spark, d):
    cells = table(spark, d, "documents").select(
        F.col("doc_id").alias("row_id"), F.col("source").alias("column"), F.col("text").alias("value")
    )
    return plan_batches(cells, token_limit=LIMIT)


def _corrector():
    """Lower case and digits only for phones; fails on one column."""

    def fix(cells, context):
        if context["rule"]["name"] == "signup":
            raise RuntimeError("no answer")
        return cells.assign(corrected_value=cells["value"].str.lower() + "|" + context["instructions"])

    return fix


@query(
    "failed_calls",
    f"""WITH {duck.CLEANED}, bad AS ({duck.invalid_sql('named', 'cleaner')})
    SELECT "column", 1 AS batch, count(*) AS cells, 'RuntimeError: no answer' AS error
    FROM bad WHERE "column" = 'signup' GROUP BY "column" """,
)
def failed_calls(spark, d):
    invalid = split_valid_invalid(named_customers(spark, d), RULES, "cleaner")[1]
    return ask_corrector(invalid, RULES, _corrector(), "short")[1]


@query(
    "correct_cells",
    f"""WITH {duck.CLEANED}, bad AS ({duck.invalid_sql('named', 'cleaner')})
    SELECT row_id, "column", lower(value) || '|short' AS corrected_value,
      concat("column", '_batch_1') AS source,
      row_number() OVER (PARTITION BY "column" ORDER BY row_id) AS seq
    FROM bad WHERE "column" <> 'signup'""",
)
def corrected(spark, d):
    invalid = split_valid_invalid(named_customers(spark, d), RULES, "cleaner")[1]
    return correct_cells(invalid, RULES, _corrector(), instructions="short")


_PLACE = "md5(concat('42:', o_orderkey))"
_SPLIT = f"""SELECT o_orderkey, o_custkey, CASE
  WHEN r <= floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN r <= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validate' ELSE 'test' END AS split
FROM (SELECT *, row_number() OVER (ORDER BY {_PLACE}, o_orderkey) AS r, count(*) OVER () AS n
  FROM orders)"""


def _orders(spark, d) -> DataFrame:
    return table(spark, d, "orders").select("o_orderkey", "o_custkey")


@query("split_exact", _SPLIT)
def split_exact(spark, d):
    return split_rows(_orders(spark, d), row_id="o_orderkey")


@query("split_sizes", f'SELECT split, count(*) AS "rows" FROM ({_SPLIT}) GROUP BY split')
def sizes(spark, d):
    return split_sizes(split_rows(_orders(spark, d), row_id="o_orderkey"))


@query(
    "split_by_hash",
    f"""SELECT o_orderkey, o_custkey, CASE WHEN {_PLACE} < 'b3333333' THEN 'train'
    WHEN {_PLACE} < 'd9999999' THEN 'validate' ELSE 'test' END AS split FROM orders""",
)
def split_by_hash(spark, d):
    return split_rows(_orders(spark, d), exact=False, row_id="o_orderkey")


NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINES = [*NUMBERS, "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate",
         "l_returnflag", "l_linestatus"]


def _lines(spark, d) -> DataFrame:
    """Line items with ids; one row in a thousand is far from the others."""
    lines = with_row_id(table(spark, d, "lineitem").select(*LINES), order_by=LINES)
    far = F.when(F.col("row_id") % 1000 == 0, 1000).otherwise(1)
    return lines.select("row_id", *[(F.col(c) * far).alias(c) for c in NUMBERS])


def _scored(spark, d) -> DataFrame:
    lines = _lines(spark, d)
    return iforest_score(lines, iforest_fit(lines, NUMBERS), NUMBERS)


_FOREST_SQL = f"""WITH l AS (SELECT row_number() OVER (ORDER BY {', '.join(LINES)}) AS row_id, * FROM lineitem),
    x AS (SELECT row_id, {', '.join(f'{c} * (CASE WHEN row_id % 1000 = 0 THEN 1000 ELSE 1 END) AS {c}' for c in NUMBERS)} FROM l),
    {duck.forest('x', NUMBERS)}"""


def _splits_sql(kept: str, columns: str) -> str:
    """The exact split of the rows of ``kept``."""
    return f"""SELECT {columns}, CASE WHEN r <= floor(n * 0.70::DOUBLE) THEN 'train'
      WHEN r <= floor(n * 0.70::DOUBLE) + floor(n * 0.15::DOUBLE) THEN 'validate' ELSE 'test' END AS split
    FROM (SELECT *, row_number() OVER (ORDER BY md5(concat('42:', row_id)), row_id) AS r, count(*) OVER () AS n FROM {kept})"""


@query("iforest_scores", f"{_FOREST_SQL} SELECT row_id, round(score, 9) AS score FROM scored")
def iforest_scores(spark, d):
    # Sums of a hundred path lengths differ in the last bits by their order.
    return _scored(spark, d).select("row_id", F.round("score", 9).alias("score"))


@query("outlier_report", f"{_FOREST_SQL} SELECT row_id, round(score, 3) AS score, {', '.join(NUMBERS)} FROM scored WHERE score > 0.7")
def outliers(spark, d):
    report = outlier_report(_scored(spark, d), NUMBERS)
    schema = ", ".join(f"{c} double" for c in NUMBERS)
    return report.select("row_id", "score", F.inline(F.array(F.from_json("numeric_values", schema))))


@query("drop_outliers", f"{_FOREST_SQL} SELECT row_id, {', '.join(NUMBERS)} FROM scored WHERE score <= 0.7")
def inliers(spark, d):
    return drop_outliers(_scored(spark, d))


# A forest of two small trees as given data, which SQL can walk as well.
GIVEN_NODES = [
    (0, 0, 1, 100_000.0, 1, 2, 0.0, 64), (0, 1, 0, 25.5, 3, 4, 0.0, 64), (0, 2, -1, 0.0, -1, -1, 1.0, 64),
    (0, 3, -1, 0.0, -1, -1, 7.5, 64), (0, 4, -1, 0.0, -1, -1, 8.25, 64),
    (1, 0, 0, 60.0, 1, 2, 0.0, 64), (1, 1, 2, 0.045, 3, 4, 0.0, 64), (1, 2, -1, 0.0, -1, -1, 1.0, 64),
    (1, 3, -1, 0.0, -1, -1, 6.75, 64), (1, 4, -1, 0.0, -1, -1, 9.5, 64),
]
_GIVEN_SQL = f"""WITH l AS (SELECT row_number() OVER (ORDER BY {', '.join(LINES)}) AS row_id, * FROM lineitem),
    x AS (SELECT row_id, {', '.join(f'{c} * (CASE WHEN row_id % 1000 = 0 THEN 1000 ELSE 1 END) AS {c}' for c in NUMBERS)} FROM l),
    s AS (SELECT *, round(pow(2.0::DOUBLE, -((
      CASE WHEN l_extendedprice <= 100000 THEN CASE WHEN l_quantity <= 25.5 THEN 7.5 ELSE 8.25 END ELSE 1 END
      + CASE WHEN l_quantity <= 60 THEN CASE WHEN l_discount <= 0.045 THEN 6.75 ELSE 9.5 END ELSE 1 END
      )::DOUBLE / 2 / {float(mean_path(64))!r})), 9) AS score FROM x)"""


def _given(spark, d) -> DataFrame:
    nodes = spark.createDataFrame(GIVEN_NODES, NODE_SCHEMA)
    scored = iforest_score(_lines(spark, d), nodes, NUMBERS)
    return scored.withColumn("score", F.round("score", 9))


@query("iforest_scores_given", f"{_GIVEN_SQL} SELECT row_id, score FROM s")
def given_scores(spark, d):
    return _given(spark, d).select("row_id", "score")


@query("outlier_report_given", f"{_GIVEN_SQL} SELECT row_id, round(score, 3) AS score FROM s WHERE score > 0.7")
def given_outliers(spark, d):
    return outlier_report(_given(spark, d), NUMBERS).select("row_id", "score")


@query("drop_outliers_given", f"{_GIVEN_SQL} SELECT row_id, {', '.join(NUMBERS)} FROM s WHERE score <= 0.7")
def given_inliers(spark, d):
    return drop_outliers(_given(spark, d))


NUMBER_RULES = [
    *[ColumnRule(c, c, index=i, data_type="float") for i, c in enumerate(NUMBERS, start=1)],
]


@query("iso_split", f"{_FOREST_SQL}, kept AS (SELECT * FROM scored WHERE score <= 0.7) {_splits_sql('kept', ', '.join(['row_id', *NUMBERS]))}")
def isolated(spark, d):
    return iso_split(_lines(spark, d), NUMBER_RULES).table


@query("run_preclean_and_stitch", f"{STITCH_SQL} SELECT * FROM patched")
def run_stitched(spark, d):
    return _run(spark, d, frozenset({"dedupe", "isosplit", "clean"}))["stitched"]


def _run(spark, d, skip: frozenset) -> dict[str, DataFrame]:
    return run(
        messy_customers(spark, d),
        RunConfig(
            contract=RULES,
            row_patches=row_patches(spark, d),
            cell_patches=cell_patches(spark, d),
            standard_forms={"phone": S.phone_e164, "signup": S.iso_date},
            skip=skip,
        ),
    )


# All six stages on customers whose names are near duplicates.
WHOLE = {**NEAR, **{c: MESSY[c] for c in ("Phone", "Signup", "Balance", "raw_data")}}
WHOLE_RULES = [
    ColumnRule("name", "key name", is_unique=True, index=1, regex="^[a-z]"),
    ColumnRule("note", "note", index=2, regex="^.*$"),
    ColumnRule("Phone", "phone", index=3, regex=RULES[2].regex),
    ColumnRule("Signup", "signup", index=4, data_type="date", regex=RULES[3].regex),
    ColumnRule("Balance", "balance", index=5, data_type="float"),
]


def _whole(spark, d) -> dict[str, DataFrame]:
    customers = table(spark, d, "customer").select(*[F.expr(e).alias(n) for n, e in WHOLE.items()])
    forms = {"phone": S.phone_e164, "signup": S.iso_date}
    lines = spark.createDataFrame([("# not for this run",), (" raw_data ",), ("no such column",)], "value string")
    return run(
        customers,
        RunConfig(exclusions=parse_exclusions(lines), contract=WHOLE_RULES, standard_forms=forms),
    )



_WHOLE_SQL = "SELECT " + ", ".join(f'{e} AS "{n}"' for n, e in WHOLE.items()) + " FROM customer"
_GONE = GROUPS_SQL + ", gone AS (SELECT row_id FROM groups WHERE role = 'duplicate')"
_STANDARD = (
    'SELECT row_id, name, note, "Phone", coalesce(CASE WHEN NOT {e1} THEN {phone} END, "Phone") AS phone2, '
    '"Signup", coalesce(CASE WHEN NOT {e2} THEN {date} END, "Signup") AS signup2, "Balance" '
    "FROM whole WHERE row_id NOT IN (SELECT row_id FROM gone)"
).format(
    e1=duck.empty('"Phone"', "unified"), e2=duck.empty('"Signup"', "unified"), phone=PHONE, date=DATE
)


@query(
    "run_all_stages_table",
    f"""{_GONE}, raw AS ({_WHOLE_SQL}), whole AS (SELECT row_id, {duck.clean('name')} AS name,
    {duck.clean('note')} AS note, {duck.clean('"Phone"')} AS "Phone",
    {duck.clean('"Signup"')} AS "Signup", {duck.clean('"Balance"')} AS "Balance" FROM raw),
    standard AS ({_STANDARD})
    SELECT row_id, name AS "key name", note, phone2 AS phone, signup2 AS signup,
      "Balance" AS balance FROM standard""",
)
def run_table(spark, d):
    return _whole(spark, d)["stitched"]


_STITCHED = '"key name", note, phone, signup, balance'


@query(
    "run_all_stages_splits",
    f"""{_GONE}, raw AS ({_WHOLE_SQL}), whole AS (SELECT row_id, {duck.clean('name')} AS name,
    {duck.clean('note')} AS note, {duck.clean('"Phone"')} AS "Phone",
    {duck.clean('"Signup"')} AS "Signup", {duck.clean('"Balance"')} AS "Balance" FROM raw),
    standard AS ({_STANDARD}),
    x AS (SELECT row_id, {number_sql('"Balance"')} AS number FROM standard), {duck.forest('x', ['number'])},
    kept AS (SELECT row_id, name AS "key name", note, phone2 AS phone, signup2 AS signup, "Balance" AS balance
      FROM standard JOIN scored USING (row_id) WHERE score <= 0.7)
    {_splits_sql('kept', f'row_id, {_STITCHED}')}""",
)
def run_splits(spark, d):
    return _whole(spark, d)["splits"]



@query("stream_clean", f"""WITH d AS (SELECT doc_id AS row_id, {duck.clean('text')} AS body,
    {duck.clean('source')} AS origin FROM documents)
    SELECT row_id, 'body' AS "column", body AS value FROM d
    WHERE NOT {duck.empty('body', 'cleaner')} AND NOT regexp_matches(body, '^[A-Z][a-z ]+')""")
def stream_clean(spark, d):
    stream = (
        # The table may be one file or a folder of part files. A stream takes a file by a pattern only.
        spark.readStream.schema(table(spark, d, "documents").schema)
        .parquet(f"{d}/document[s].parquet")
        .select(F.col("doc_id").alias("row_id"), "text", "source")
    )
    rules = [
        ColumnRule("text", "body", index=1, regex="^[A-Z][a-z ]+"),
        ColumnRule("source", "origin", index=2, regex="^.*$"),
    ]
    invalid = clean_stream(stream, rules)[1]
    out = scratch(spark)
    write_available(invalid, f"{out}/rows", f"{out}/progress").awaitTermination()
    # A table without invalid cells leaves no file to take the columns from.
    return spark.read.schema(invalid.schema).parquet(f"{out}/rows")
