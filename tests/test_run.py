"""The full run, the stream, and the shape of the plans."""

from hashlib import md5

import pytest
from pyspark.sql import functions as F

from checks import QUERIES, load_all
from sparkscour.functions.standardize import COMPANY_SUFFIXES, company_name, iso_date, phone_e164, usd
from sparkscour.operators.pairs import distinct_keys, similarity_pairs
from sparkscour.operators.profile import propose_contract
from sparkscour.plans.preclean import preclean, preclean_report
from sparkscour.plans.run import RunConfig, run
from sparkscour.plans.stitch import stitch
from sparkscour.session import durable
from sparkscour.sources.contracts import ColumnRule, rules_of
from sparkscour.streaming.clean import clean_stream, write_available

load_all()
ROWS = [
    (1, "Ann  Lee", "(555) 123-4567", "10"),
    (2, "ann lee!", "5551234567", "11"),
    (3, "Bob", "12", "12"),
    (4, "", "null", "9000000"),
    *[(i, f"p{md5(str(i).encode()).hexdigest()}", "+15550000000", str(i % 7)) for i in range(5, 60)],
]
RULES = [
    ColumnRule("Name", "name", is_unique=True, index=1, regex="^[A-Za-z]"),
    ColumnRule("Phone", "phone", index=2, regex=r"^\+1\d{10}$"),
    ColumnRule("Amount", "amount", index=3, data_type="int"),
]


@pytest.fixture
def table(spark):
    return spark.createDataFrame(ROWS, "row_id long, Name string, Phone string, Amount string")


def test_run_keeps_row_ids_through_all_stages(spark, table):
    patches = spark.createDataFrame(
        [(3, "phone", "+15559999999", "f", 1), (2, "phone", "gone", "f", 2)],
        "row_id long, column string, corrected_value string, source string, seq long",
    )
    out = run(table, RunConfig(contract=RULES, cell_patches=patches, standard_forms={"phone": phone_e164}))
    assert sorted(r["row_id"] for r in out["deduped"].collect()) == [1, *range(3, 60)]
    fixed = {r["row_id"]: r["phone"] for r in out["stitched"].collect()}
    assert (fixed[1], fixed[3], fixed[4]) == ("+15551234567", "+15559999999", "null")
    flagged = [r for r in out["change_log"].collect() if r["is_flagged"]]
    assert [(r["row_id"], r["column"]) for r in flagged] == [(4, "phone")]
    assert {r["column"]: r["outcome"] for r in out["column_outcomes"].collect()} == {
        "name": "already valid", "phone": "cleaned", "amount": "already valid",
    }
    assert out["validation_summary"].first()["improvement"] > 0
    ids = {r["row_id"] for r in out["splits"].collect()} | {r["row_id"] for r in out["outliers"].collect()}
    assert ids == {1, *range(3, 60)}


def test_run_skips_stages_and_stops_on_errors(spark, table):
    skip = frozenset({"preclean", "dedupe", "clean", "isosplit"})
    out = run(table, RunConfig(contract=RULES, skip=skip))
    assert out["stitched"].count() == len(ROWS)
    assert not {"deduped", "splits", "column_outcomes", "preclean_stats"} & set(out)
    with pytest.raises(ValueError):
        run(table, RunConfig(skip=frozenset({"contract"})))
    with pytest.raises(ValueError):
        run(table, RunConfig(contract=RULES[:2], skip=frozenset({"dedupe"})))


def test_run_proposes_a_contract(spark, table):
    out = run(table, RunConfig(skip=frozenset({"dedupe"})))
    assert {r.name: r.data_type for r in rules_of(out["contract"])} == {
        "name": "string", "phone": "int", "amount": "int",
    }


def test_preclean_modes(spark, table):
    assert preclean(table, ["Phone"]).columns == ["row_id", "Name", "Amount"]
    kept = preclean(table, ["Name"], mode="keep").collect()
    assert [r["Name"] for r in kept if r["row_id"] == 1] == ["Ann  Lee"]
    stats, totals = preclean_report(table, ["Phone"])
    assert {r["column"]: r["modified_count"] for r in stats.collect()} == {"Name": 1, "Amount": 0}
    assert totals.first().asDict() == {
        "rows": len(ROWS), "columns": 2, "columns_removed": 1, "columns_changed": 1, "values_changed": 1,
    }


def test_stitch_without_patches_still_flags(spark, table):
    done = stitch(table, RULES)
    assert done.table.columns == ["row_id", "name", "phone", "amount"]
    log = done.change_log.collect()
    assert {r["row_id"] for r in log} == {1, 2, 3, 4} and all(r["unable_to_fix"] for r in log)
    assert [r["status"] for r in done.report().collect()] == ["FLAGGED"] * 4
    assert done.totals().first()["flagged"] == 4


def test_standard_forms(spark):
    df = spark.createDataFrame([("555-123-4567", "31 Jan 2024", "Acme, Inc.", "-1234.5"), ("1", "2024-02-30", "Inc", "x")], "p string, d string, c string, m string")
    got = [tuple(r) for r in df.select(phone_e164("p"), iso_date("d"), company_name("c"), usd("m")).collect()]
    assert got == [("+15551234567", "2024-01-31", "Acme", "-$1,234.50"), (None, None, "Inc", None)]
    assert "LLC" in COMPANY_SUFFIXES


def test_profile(spark, table):
    rows = {r["name"]: r for r in propose_contract(table.drop("row_id"), ["Name", "Phone", "Amount"]).collect()}
    assert rows["amount"]["regex"] == "^[+-]?[0-9]+$"
    assert not rows["name"]["is_excluded"] and rows["name"]["is_unique"]


def test_codes_are_not_proposed_as_unique(spark):
    df = spark.createDataFrame([(i, 10_000_000 + i, f"Customer#{i:09d}", f"{chr(97 + i % 26)}{chr(97 + i // 26)} word") for i in range(300)], "row_id long, account long, code string, word string")
    rows = {r["name"]: r["is_unique"] for r in propose_contract(df, ["account", "code", "word"]).collect()}
    assert rows == {"account": False, "code": False, "word": True}


def test_stream_equals_batch(spark, table, tmp_path):
    source = str(tmp_path / "in")
    table.repartition(3).write.parquet(source)
    stream = spark.readStream.schema(table.schema).parquet(source)
    patches = spark.createDataFrame(
        [(3, "phone", "+15559999999", "f", 1)],
        "row_id long, column string, corrected_value string, source string, seq long",
    )
    for side, name in enumerate(("clean", "bad")):
        parts = clean_stream(stream, RULES, ["Amount"], patches)
        out = str(tmp_path / name)
        write_available(parts[side], out, out + "_progress").awaitTermination()
        batch = clean_stream(spark.read.parquet(source), RULES, ["Amount"], patches)[side]
        assert sorted(map(tuple, spark.read.parquet(out).collect())) == sorted(map(tuple, batch.collect()))
        assert batch.count() > 0


@pytest.mark.parametrize("parts", [1, 3])
def test_stream_query_reads_a_file_or_a_folder_of_parts(spark, tmp_path, parts):
    texts = [(i, "Plain words" if i % 3 else "no capital", "web") for i in range(30)]
    df = spark.createDataFrame(texts, "doc_id long, text string, source string")
    for name, rows in (("some", df), ("none", df.filter("doc_id % 3 > 0"))):
        stored, folder = str(tmp_path / f"{name}_stored"), tmp_path / name
        rows.repartition(parts).write.parquet(stored)
        folder.mkdir()
        files = sorted((tmp_path / f"{name}_stored").glob("part-*"))
        if parts == 1:
            files[0].rename(folder / "documents.parquet")
        else:
            (folder / "documents.parquet").mkdir()
            for file in files:
                file.rename(folder / "documents.parquet" / file.name)
        found = QUERIES["stream_clean"](spark, str(folder))
        want = [(i, "body", "no capital") for i in range(0, 30, 3)] if name == "some" else []
        assert sorted(map(tuple, found.collect())) == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_plans(spark, table, tmp_path):
    source = str(tmp_path / "t")
    table.write.parquet(source)
    stored = spark.read.parquet(source)
    cleaned = preclean(stored, ["Phone", "Amount"]).filter(F.col("row_id") > 5)
    text = plan(cleaned)
    assert "PushedFilters: [IsNotNull(row_id), GreaterThan(row_id,5)]" in text
    assert "ReadSchema: struct<row_id:bigint,Name:string>" in text
    assert "Exchange" not in text
    keys = durable(distinct_keys(stored.select("row_id", F.col("Name").alias("comparison_value"))))
    pairs = plan(similarity_pairs(keys))
    assert "CartesianProduct" not in pairs and "NestedLoop" not in pairs
    done = stitch(stored, RULES)
    for df in (done.table, done.change_log, done.report()):
        assert "CartesianProduct" not in plan(df) and "NestedLoop" not in plan(df)
    assert plan(done.table).count("Exchange") == 0
    assert plan(done.change_log).count("Exchange") <= 8 and plan(done.report()).count("Exchange") <= 10
