"""Inputs derived from the given tables by expressions that both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import table
from sparkscour.functions.text import ASCII_SPELLING
from sparkscour.sources.contracts import ColumnRule

K = "c_custkey"
SYMBOLS = "".join(ASCII_SPELLING)

# Messy customers: white space, every mapped symbol, repeated quotes, empty words, bad formats.
MESSY = {
    "row_id": K,
    " Name\tFull ": (
        f"concat('  ', c_name, chr(9), chr(13), chr(10), ' ', ' ', '﻿', "
        f"substring('{SYMBOLS}', CAST(1 + {K} % 48 AS INT), 1), "
        f"repeat('\"', CAST({K} % 4 AS INT)), ' ', repeat(chr(39), CAST({K} % 3 AS INT)), "
        f"c_mktsegment, CASE WHEN {K} % 7 = 0 THEN 'é ' ELSE '' END)"
    ),
    "Email": (
        f"CASE {K} % 6 WHEN 0 THEN concat('USER', {K}, '@Example.COM') "
        f"WHEN 1 THEN concat('user', {K}, '.example.com') WHEN 2 THEN '' "
        f"WHEN 3 THEN concat(' user', {K}, '@example.org ') "
        f"ELSE concat('user', {K}, '@example.com') END"
    ),
    "Phone": (
        f"CASE {K} % 7 WHEN 0 THEN concat('(555) 12', {K} % 10, '-', 1000 + {K} % 9000) "
        f"WHEN 1 THEN concat('+155512', {K} % 10, 1000 + {K} % 9000) "
        f"WHEN 2 THEN '12345' WHEN 3 THEN 'NULL' WHEN 4 THEN 'null' "
        f"WHEN 5 THEN concat('1-555-12', {K} % 10, '-', 1000 + {K} % 9000) "
        f"ELSE concat('+155598', {K} % 10, 1000 + {K} % 9000) END"
    ),
    "Signup": (
        f"CASE {K} % 5 WHEN 0 THEN concat('2024-01-', 10 + {K} % 19) "
        f"WHEN 1 THEN concat('01/', 10 + {K} % 19, '/2023') "
        f"WHEN 2 THEN concat(10 + {K} % 19, ' Jan 2022') WHEN 3 THEN 'nan' "
        f"ELSE concat('soon ', {K}) END"
    ),
    "Company": (
        f"CASE {K} % 5 WHEN 0 THEN concat(c_mktsegment, ' Inc') "
        f"WHEN 1 THEN concat(c_mktsegment, ', Inc.') WHEN 2 THEN concat(c_mktsegment, ' LLC') "
        f"WHEN 3 THEN '   ' ELSE c_mktsegment END"
    ),
    "Balance": (
        f"CASE {K} % 7 WHEN 0 THEN concat({K}, 'abc') WHEN 1 THEN '-' WHEN 2 THEN 'undefined' "
        f"WHEN 3 THEN '' WHEN 4 THEN concat({K} % 90, '.5e1') ELSE CAST(c_acctbal AS STRING) END"
    ),
    "raw_data": f"concat('raw ', {K})",
}
MESSY_SQL = (
    "SELECT " + ", ".join(f'{expr} AS "{name}"' for name, expr in MESSY.items()) + " FROM customer"
)

# The contract of the messy customers, bound to the headers after cleaning.
RULES = [
    ColumnRule("Name Full", "full name", False, True, 1, "string", "Whole name", "Ann",
               r"^Customer#\d{9} [^<>]*$"),
    ColumnRule("Email", "email", False, False, 2, "string", "Address", "a@b.co",
               r"^[a-z0-9.]+@[a-z0-9.]+\.[a-z]{2,}$"),
    ColumnRule("Phone", "phone", False, False, 3, "string", "Phone", "+15551234567", r"^\+1\d{10}$"),
    ColumnRule("Signup", "signup", False, False, 4, "date", "Day", "2024-01-31",
               r"^\d{4}-\d{2}-\d{2}$"),
    ColumnRule("Company", "Company", False, False, 5, "string", "Employer", "Acme", "^.*$"),
    ColumnRule("Balance", "balance", False, False, 6, "float", "Money", "1.5", ""),
    ColumnRule("raw_data", "raw", True, False, 7, "string", "Raw", "", r"^\d+$"),
]
NAMES = [r.name for r in RULES]

# Near duplicates: md5 keys, some cut and extended, some in upper case, some empty.
_PART = "substring(md5(CAST({} AS STRING)), 1, 22)"
NEAR = {
    "row_id": K,
    "name": (
        f"CASE WHEN {K} % 50 = 3 THEN '' "
        f"WHEN {K} % 10 = 1 THEN concat(substring({_PART.format(f'{K} - 1')}, 1, 20), 'zz') "
        f"WHEN {K} % 10 = 2 THEN upper({_PART.format(f'{K} - 2')}) "
        f"WHEN {K} % 10 = 6 "
        f"THEN concat('north unit of ', substring({_PART.format(f'{K} - 1')}, 1, 20), 'zz') "
        f"WHEN {K} % 10 = 5 THEN concat('north unit of ', {_PART.format(K)}) "
        f"WHEN {K} % 100 = 7 THEN 'shared value of many rows' "
        f"ELSE {_PART.format(K)} END"
    ),
    "note": f"CASE WHEN {K} % 4 = 0 THEN '' ELSE concat('note ', {K} % 3, ', \"', c_mktsegment, '\"') END",
}
NEAR_SQL = (
    "SELECT " + ", ".join(f"{expr} AS {name}" for name, expr in NEAR.items()) + " FROM customer"
)

CELL_PATCHES_SQL = """
SELECT {k} AS row_id, 'email' AS "column", concat('user', {k}, '@example.com') AS corrected_value,
       'email_output.txt' AS source, {k} AS seq
FROM customer WHERE {k} % 3 <> 2
UNION ALL
SELECT {k}, 'email', concat('late', {k}, '@example.com'), 'email_output.txt', {k} + 1000000000
FROM customer WHERE {k} % 12 = 0
UNION ALL
SELECT {k}, 'signup', concat('2024-01-', 10 + {k} % 19), 'signup_output.txt', {k}
FROM customer WHERE {k} % 5 = 0
UNION ALL
SELECT {k}, 'phone', 'still bad', 'phone_output.txt', {k} FROM customer WHERE {k} % 7 = 2
UNION ALL
SELECT {k}, 'nothing', 'x', 'nothing_output.txt', {k} FROM customer WHERE {k} % 10 = 0
UNION ALL
SELECT -{k}, 'email', 'x@example.com', 'other_output.txt', {k} FROM customer WHERE {k} % 10 = 0
""".format(k=K)

ROW_PATCHES_SQL = """
SELECT {k} AS row_id, ['Customer#000000001 fixed', 'first@example.com'] AS "values",
       FALSE AS flagged, {k} AS seq
FROM customer WHERE {k} % 4 = 0
UNION ALL
SELECT {k}, ['Customer#000000002 later'], TRUE, {k} + 1000000000 FROM customer WHERE {k} % 8 = 0
UNION ALL
SELECT {k}, ['a', 'b', 'c', 'd', 'e', 'f', 'g', 'too', 'long'], FALSE, {k} + 2000000000
FROM customer WHERE {k} % 40 = 0
UNION ALL
SELECT -{k}, ['gone'], FALSE, {k} FROM customer WHERE {k} % 10 = 0
""".format(k=K)


def _sql(spark: SparkSession, folder: str, text: str) -> DataFrame:
    customer = table(spark, folder, "customer")
    plain = text.replace("['", "array('").replace("']", "')").replace('"', "`")
    return spark.sql(plain.replace("FROM customer", "FROM {customer}"), customer=customer)


def messy_customers(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        *[F.expr(expr).alias(name) for name, expr in MESSY.items()]
    )


def near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").select(
        *[F.expr(expr).alias(name) for name, expr in NEAR.items()]
    )


def cell_patches(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, CELL_PATCHES_SQL)


def row_patches(spark: SparkSession, folder: str) -> DataFrame:
    return _sql(spark, folder, ROW_PATCHES_SQL)
