"""Text cleaning, keys, CSV text, exclusion lists and table files."""

from __future__ import annotations

from pyspark.sql import functions as F

from checks import duck, query, scratch, table
from checks.inputs import MESSY_SQL, messy_customers
from sparkscour.functions import text as T
from sparkscour.operators.columns import clean_headers, drop_excluded
from sparkscour.operators.rows import distributed_rank, head_sample, with_row_id
from sparkscour.plans.preclean import preclean, preclean_report
from sparkscour.sources.exclusions import parse_exclusions
from sparkscour.sources.tables import read_table, write_table

TEXTS = ("text", "lang", "source")


@query(
    "preclean_documents",
    "SELECT doc_id, " + ", ".join(f"{duck.clean(c)} AS {c}" for c in TEXTS)
    + ", n_chars FROM documents",
)
def preclean_documents(spark, d):
    return preclean(table(spark, d, "documents"), row_id="doc_id")


@query(
    "preclean_pages",
    f"SELECT page_id, {duck.clean('url')} AS url, {duck.clean('html')} AS html FROM pages",
)
def preclean_pages(spark, d):
    return preclean(table(spark, d, "pages"), row_id="page_id")


@query(
    "preclean_messy_customers",
    f"WITH messy AS ({MESSY_SQL}) SELECT row_id, "
    + ", ".join(
        f'{duck.clean(chr(34) + h + chr(34))} AS "{h.strip().replace(chr(9), " ")}"'
        for h in duck.HEADERS
        if h != "raw_data"
    )
    + " FROM messy",
)
def preclean_messy_customers(spark, d):
    return preclean(messy_customers(spark, d), exclusions=["raw_data", "not there"])


@query(
    "clean_headers_drop_excluded",
    f'WITH messy AS ({MESSY_SQL}) SELECT row_id, " Name\tFull " AS "Name Full", "Email", '
    '"Phone", "Signup", "Company", "Balance" FROM messy',
)
def clean_headers_drop_excluded(spark, d):
    return drop_excluded(clean_headers(messy_customers(spark, d)), ["raw_data"])


def _stats_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS DISTINCT FROM {duck.clean(c)}) "
        f"AS modified_count, count(*) AS total_count FROM documents"
        for c in TEXTS
    )


@query("preclean_stats", _stats_sql())
def preclean_stats(spark, d):
    return preclean_report(table(spark, d, "documents"), row_id="doc_id")[0]


@query(
    "preclean_totals",
    f"WITH s AS ({_stats_sql()}) SELECT max(total_count) AS rows, count(*) AS columns, "
    "CAST(1 AS BIGINT) AS columns_removed, "
    "count(*) FILTER (modified_count > 0) AS columns_changed, "
    "CAST(sum(modified_count) AS BIGINT) AS values_changed FROM s WHERE \"column\" <> 'lang'",
)
def preclean_totals(spark, d):
    return preclean_report(table(spark, d, "documents"), ["lang"], row_id="doc_id")[1]


@query(
    "text_steps",
    f"""SELECT conv_id, turn, {duck.collapse('text')} AS collapsed, {duck.spell('text')} AS spelled,
    {duck.quotes('text')} AS quotes, {duck.ascii_only('text')} AS ascii,
    {duck.clean('text')} AS cleaned FROM conversations""",
)
def text_steps(spark, d):
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        T.collapse_space("text").alias("collapsed"),
        T.spell_ascii("text").alias("spelled"),
        T.collapse_quotes("text").alias("quotes"),
        T.strip_non_ascii("text").alias("ascii"),
        T.clean_text("text").alias("cleaned"),
    )


@query(
    "comparison_key",
    f"SELECT doc_id, {duck.norm('text')} AS text_key, {duck.key('source', 'text')} AS both_key "
    "FROM documents",
)
def comparison_key(spark, d):
    return table(spark, d, "documents").select(
        "doc_id",
        T.normalize_key("text").alias("text_key"),
        T.comparison_key("source", "text").alias("both_key"),
    )


@query(
    "csv_text",
    f"""SELECT conv_id, turn, {duck.csv('text')} AS quoted,
    CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, text AS unquoted,
    concat_ws(',', {duck.csv('role')}, {duck.csv('text')}) AS line, [role, text] AS fields,
    ['', '', role, text, ''] AS edge_fields
    FROM conversations""",
)
def csv_text(spark, d):
    line = T.csv_line("role", "text")
    return table(spark, d, "conversations").select(
        "conv_id",
        "turn",
        T.csv_quote("text").alias("quoted"),
        T.token_estimate("text").alias("tokens"),
        T.unquote(T.csv_quote("text")).alias("unquoted"),
        line.alias("line"),
        T.csv_fields(line).alias("fields"),
        T.csv_fields(F.concat(F.lit(",,"), line, F.lit(","))).alias("edge_fields"),
    )


@query(
    "exclusion_list",
    f"""SELECT DISTINCT {duck.trim('line')} AS "column" FROM (
    SELECT unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE {duck.trim('line')} <> '' AND NOT starts_with({duck.trim('line')}, '#')""",
)
def exclusion_list(spark, d):
    lines = table(spark, d, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return parse_exclusions(lines)


ORDERS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"]


@query(
    "head_sample",
    f"""SELECT o_orderkey AS row_id, 'ID,o_custkey,o_orderstatus,o_orderpriority' AS header,
    concat_ws(',', o_orderkey, {', '.join(duck.csv(c) for c in ORDERS[1:])}) AS line
    FROM orders ORDER BY o_orderkey LIMIT 5""",
)
def head_sample_orders(spark, d):
    orders = table(spark, d, "orders").select(*ORDERS)
    return head_sample(with_row_id(orders, id_col="o_orderkey").drop("o_orderkey"), 5)


LINES = (
    "l_orderkey l_partkey l_suppkey l_linenumber l_quantity l_extendedprice l_discount l_tax "
    "l_returnflag l_linestatus l_shipdate"
).split()


@query(
    "row_ids",
    f"SELECT row_number() OVER (ORDER BY {', '.join(LINES)}) AS row_id, l_orderkey, l_partkey, "
    "l_extendedprice FROM lineitem",
)
def row_ids(spark, d):
    lines = table(spark, d, "lineitem").select(*LINES)
    return with_row_id(lines, order_by=LINES).select(
        "row_id", "l_orderkey", "l_partkey", "l_extendedprice"
    )


@query(
    "ranks_within",
    "SELECT event_id, event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) "
    "AS rank FROM events",
)
def ranks_within(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type", "ts")
    return distributed_rank(events, ["ts", "event_id"], within=["event_type"]).drop("ts")


@query(
    "csv_files",
    "SELECT row_number() OVER (ORDER BY conv_id, turn, role, text) AS row_id, "
    "CAST(conv_id AS VARCHAR) AS conv_id, CAST(turn AS VARCHAR) AS turn, role, "
    "text FROM conversations",
)
def csv_files(spark, d):
    talk = table(spark, d, "conversations").orderBy("conv_id", "turn", "role", "text")
    path = scratch(spark)
    write_table(talk, path, "csv", source_path=f"{d}/conversations.parquet")
    return with_row_id(read_table(spark, path, "csv", with_position=True))


@query(
    "csv_quoted_breaks",
    "SELECT row_number() OVER (ORDER BY doc_id) AS row_id, CAST(doc_id AS VARCHAR) AS doc_id, "
    "nullif(text, '') AS text FROM documents",
)
def csv_quoted_breaks(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text").orderBy("doc_id")
    path = scratch(spark)
    write_table(docs, path, "csv", source_path=f"{d}/documents.parquet")
    return with_row_id(read_table(spark, path, "csv", with_position=True, ranges=True))
