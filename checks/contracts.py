"""Contracts: parsed from replies, as JSON, renaming, scoping, and proposed from data."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck, query, table
from checks.inputs import MESSY_SQL, RULES, messy_customers
from sparkscour.operators.columns import rename_by_contract
from sparkscour.operators.patterns import induced_patterns
from sparkscour.operators.profile import propose_contract
from sparkscour.operators.reply_text import parse_contract, scope_contract
from sparkscour.plans.preclean import preclean
from sparkscour.sources.contracts import (
    ColumnRule,
    active_columns,
    contract_from_json,
    contract_to_json,
    unique_columns,
)

# One schema-design reply per supplier. Of three originals, suppliers with an odd key get a fourth
# without a design; those with a key that 4 divides get a design without an original.
DESIGN = [
    ("```UNIQUE```", "Supplier Name", "string", '"Name, ""full"""', "{name}", r"^Supplier#\d{1,3},\d+$"),
    ("```EXCLUDE```", "acct", "float", "Balance", "1.5", r"^-?\d+\.\d+$"),
    ("", "nation key", "int", "", "{nation}", r"^\d+$"),
]
ORIGINALS = ["s_name", "s_acctbal", '"s,nation"']


def _replies(spark, d):
    lines = [
        F.concat(
            F.lit(f"{mark}{name},{kind},{text},"),
            F.col("s_name") if "{name}" in example
            else F.col("s_nationkey").cast("string") if "{nation}" in example
            else F.lit(example),
            F.lit("," + regex),
        )
        for mark, name, kind, text, example, regex in DESIGN
    ]
    odd, fourth = F.col("s_suppkey") % 2 == 1, F.col("s_suppkey") % 4 == 0
    header = F.concat_ws(",", F.lit("ID"), *map(F.lit, ORIGINALS), F.when(odd, F.lit("s_extra")))
    design = F.concat_ws(
        "\n",
        F.lit("data_title,data_type,data_description,data_example,data_regex"),
        *lines,
        F.lit("   "),
        F.when(fourth, F.lit("added,string")),
    )
    text = F.concat(
        F.lit("Here.\n<user_data>\n"), header, F.lit("\n1,a,b,c\n</user_data>\n<schema_design>\n"),
        design, F.lit("\n</schema_design> done"),
    )
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("reply_id"), text.alias("text"))


_FIELDS = (
    "original_name, name, is_excluded, is_unique, index, data_type, description, example, regex"
)
CONTRACT_SQL = f"""
SELECT s_suppkey AS reply_id, 's_name' AS original_name, 'Supplier Name' AS name,
  FALSE AS is_excluded, TRUE AS is_unique, 1 AS index, 'string' AS data_type,
  'Name, "full"' AS description, s_name AS example, {duck.lit(DESIGN[0][5])} AS regex FROM supplier
UNION ALL SELECT s_suppkey, 's_acctbal', 'acct', TRUE, FALSE, 2, 'float', 'Balance', '1.5',
  {duck.lit(DESIGN[1][5])} FROM supplier
UNION ALL SELECT s_suppkey, 's,nation', 'nation key', FALSE, FALSE, 3, 'int', '',
  CAST(s_nationkey AS VARCHAR), {duck.lit(DESIGN[2][5])} FROM supplier
UNION ALL SELECT s_suppkey, 's_extra', 'UNMAPPED_3', FALSE, FALSE, 4, '', '', '', ''
  FROM supplier WHERE s_suppkey % 2 = 1
UNION ALL SELECT s_suppkey, 'MISSING_ORIGINAL_3', 'added', FALSE, FALSE, 4, 'string', '', '', ''
  FROM supplier WHERE s_suppkey % 4 = 0
"""


@query("contract_parse", CONTRACT_SQL)
def contract_parse(spark, d):
    return parse_contract(_replies(spark, d))


@query("contract_json_roundtrip", CONTRACT_SQL)
def contract_json_roundtrip(spark, d):
    docs = contract_to_json(parse_contract(_replies(spark, d)), "reply_id")
    return contract_from_json(docs, "json", "reply_id")


@query(
    "contract_columns",
    f"""WITH c AS ({CONTRACT_SQL})
    SELECT 'numeric' AS picked, reply_id, name, index FROM c
    WHERE NOT is_excluded AND data_type IN ('int', 'float')
    UNION ALL SELECT 'active', reply_id, name, index FROM c WHERE NOT is_excluded
    UNION ALL SELECT 'unique', reply_id, name, index FROM c WHERE is_unique""",
)
def contract_columns(spark, d):
    contract = parse_contract(_replies(spark, d))
    picks = {
        "numeric": active_columns(contract, ("int", "float")),
        "active": active_columns(contract),
        "unique": unique_columns(contract),
    }
    parts = [
        p.select(F.lit(n).alias("picked"), "reply_id", "name", "index") for n, p in picks.items()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


_LINE = "concat_ws(',', name, data_type, description, example, regex)"
_HEAD = "'data_title,data_type,data_description,data_example,data_regex' || chr(10)"


@query(
    "contract_scope",
    f"""WITH c AS ({CONTRACT_SQL})
    SELECT reply_id, name AS "column", {_HEAD} || {_LINE} AS schema_text, TRUE AS found
    FROM c WHERE name = 'nation key'
    UNION ALL SELECT reply_id, 'unknown', {_HEAD} || string_agg({_LINE}, chr(10) ORDER BY index),
    FALSE FROM c GROUP BY reply_id""",
)
def contract_scope(spark, d):
    contract = parse_contract(_replies(spark, d))
    wanted = table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("reply_id"),
        F.explode(F.array(F.lit("nation key"), F.lit("unknown"))).alias("column"),
    )
    return scope_contract(contract, wanted, keep=("reply_id",))


ORDER_RULES = [
    ColumnRule("o_orderkey", "Order Key", index=1),
    ColumnRule("moved", "customer", index=2),
    ColumnRule("o_orderstatus", "o_orderstatus", is_excluded=True, index=3),
    ColumnRule("o_totalprice", "total", index=4),
    ColumnRule("beyond", "nothing", index=40),
]


@query(
    "rename_by_contract",
    'SELECT o_orderkey AS "Order Key", o_custkey AS customer, o_orderstatus, '
    "o_totalprice AS total, o_orderdate, o_orderpriority FROM orders",
)
def rename_orders(spark, d):
    return rename_by_contract(table(spark, d, "orders"), ORDER_RULES)


@query(
    "rename_by_name",
    'SELECT o_orderkey AS "Order Key", o_custkey, o_orderstatus, o_totalprice AS total, '
    "o_orderdate, o_orderpriority FROM orders",
)
def rename_orders_by_name(spark, d):
    return rename_by_contract(table(spark, d, "orders"), ORDER_RULES, bind="name")


def _profile_sql(source: str, columns: list[str]) -> str:
    parts = []
    for i, name in enumerate(columns, start=1):
        x = f'CAST("{name}" AS VARCHAR)'
        v = f"CASE WHEN NOT {duck.empty(x, 'unified')} THEN {x} END"

        def hits(pattern: str) -> str:
            return f"count(*) FILTER (regexp_matches(v, '{pattern}'))"

        parts.append(
            f"""SELECT {duck.lit(name)} AS original_name, {i} AS index, count(*) AS total,
            count(v) AS filled, count(DISTINCT v) AS uniq, coalesce(min(length(v)), 0) AS shortest,
            coalesce(max(length(v)), 0) AS longest, coalesce(min(v), '') AS example,
            {hits('[0-9]')} AS digits, {hits('^[+-]?[0-9]+$')} AS ints, {hits('^[+-]?[0-9]+[.][0-9]+$')} AS floats,
            {hits('^[0-9]{4}-[0-9]{2}-[0-9]{2}$')} AS dates,
            {hits('^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+[.][A-Za-z]{2,}$')} AS mails
            FROM (SELECT {v} AS v FROM {source})"""
        )
    return f"""
    SELECT original_name, trim(regexp_replace(lower(original_name), '[^a-z0-9]+', '_', 'g'), '_')
      AS name, filled = 0 AS is_excluded,
      filled > 0 AND uniq = filled AND digits < filled * 0.95 AS is_unique,
      index, kind AS data_type,
      concat(filled, ' values of ', shortest, ' to ', longest, ' characters') AS description,
      example, CASE kind WHEN 'int' THEN '^[+-]?[0-9]+$'
        WHEN 'float' THEN '^[+-]?[0-9]+(\\.[0-9]+)?$'
        WHEN 'date' THEN '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'
        WHEN 'email' THEN '^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{{2,}}$'
        ELSE '^.*$' END AS regex
    FROM (SELECT *, CASE WHEN filled = 0 THEN 'string' WHEN ints >= filled * 0.95 THEN 'int'
      WHEN ints + floats >= filled * 0.95 THEN 'float' WHEN dates >= filled * 0.95 THEN 'date'
      WHEN mails >= filled * 0.95 THEN 'email' ELSE 'string' END AS kind
      FROM ({' UNION ALL '.join(parts)}))"""


CUSTOMER = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
MESSY_COLUMNS = duck.HEADERS


@query("propose_contract", _profile_sql("customer", CUSTOMER))
def propose_customer(spark, d):
    return propose_contract(table(spark, d, "customer"), CUSTOMER)


NATION = ["n_nationkey", "n_name", "n_regionkey"]


@query("propose_contract_words", _profile_sql("nation", NATION))
def propose_nation(spark, d):
    """A column of different words, which is proposed as unique."""
    return propose_contract(table(spark, d, "nation"), NATION)


@query(
    "propose_contract_messy",
    f"WITH messy AS ({MESSY_SQL}) {_profile_sql('messy', MESSY_COLUMNS)}",
)
def propose_messy(spark, d):
    return propose_contract(messy_customers(spark, d), MESSY_COLUMNS)


PATTERNED = ["full name", "email", "phone", "signup", "Company", "balance"]


@query("induced_patterns", f"WITH {duck.CLEANED}, {duck.patterns('named', PATTERNED)} SELECT * FROM learned")
def induced_customer_patterns(spark, d):
    return induced_patterns(rename_by_contract(preclean(messy_customers(spark, d)), RULES), PATTERNED)


PART = ["p_name", "p_brand", "p_type", "p_size", "p_retailprice"]


@query("induced_patterns_part", f"WITH {duck.patterns('part', PART)} SELECT * FROM learned")
def induced_part_patterns(spark, d):
    return induced_patterns(table(spark, d, "part"), PART)
