"""Run a registered query on Spark and its SQL on DuckDB, and compare rows and types."""

from __future__ import annotations

import sys
import time
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

KINDS = {
    "bigint": "bigint", "int": "integer", "string": "varchar", "double": "double",
    "boolean": "boolean", "array<string>": "varchar[]", "timestamp": "timestamp",
}


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{folder}/{name}.parquet"
        if Path(path).exists():
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return repr(value + 0.0)
    if isinstance(value, (list, tuple)):
        return repr([plain(v) for v in value])
    return repr(value)


def rows_of(columns: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


def compare(spark, con, name: str, folder: str) -> str:
    import checks

    started = time.time()
    df = checks.QUERIES[name](spark, folder)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    spent = time.time() - started
    if name not in checks.ORACLES:
        return f"rows {len(got)} ({spent:.1f}s)"
    started = time.time()
    result = con.execute(checks.ORACLES[name])
    columns = [c[0] for c in result.description]
    kinds = {c[0]: str(c[1]).lower() for c in result.description}
    want = rows_of(columns, result.fetchall())
    took = time.time() - started
    if sorted(df.columns) != sorted(columns):
        return f"COLUMNS {sorted(df.columns)} != {sorted(columns)}"
    types = [
        (c, t, kinds[c]) for c, t in df.dtypes if KINDS.get(t, t) != kinds[c]
    ]
    note = f" TYPES {types}" if types else ""
    if got != want:
        extra = sorted(set(got) - set(want))[:3]
        missing = sorted(set(want) - set(got))[:3]
        return (
            f"DIFFERENT spark {len(got)} sql {len(want)}{note}\n"
            f"   only spark: {[str(r)[:600] for r in extra]}\n   only sql: {[str(r)[:600] for r in missing]}"
        )
    return f"ok {len(got)} ({spent:.1f}s / {took:.1f}s){note}"


if __name__ == "__main__":
    sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
    from pyspark.sql import SparkSession

    import __spark_entry__  # noqa: F401
    import checks

    folder = sys.argv[1]
    wanted = sys.argv[2:]
    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    for name in checks.QUERIES:
        if not wanted or any(w in name for w in wanted):
            try:
                print(name, compare(spark, con, name, folder), flush=True)
            except Exception as error:
                print(name, "FAILED", type(error).__name__, str(error)[:1500], flush=True)
