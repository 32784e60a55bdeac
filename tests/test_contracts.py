import random
import re

import pytest
from pyspark.sql import functions as F

from sparkscour.functions.validity import is_empty, leading_number, matches_contract, usable_pattern
from sparkscour.operators.columns import clean_headers, drop_excluded, rename_by_contract
from sparkscour.operators.patterns import induced_patterns
from sparkscour.operators.profile import propose_contract
from sparkscour.operators.reply_text import (
    parse_cell_patches,
    parse_contract,
    parse_decisions,
    parse_row_patches,
    section,
)
from sparkscour.operators.validation import invalid_cells, validation_stats
from sparkscour.sources.contracts import ColumnRule


def reply(spark, text, **more):
    names = ["reply_id", *more, "text"]
    return spark.createDataFrame([(1, *more.values(), text)], names)


def test_parse_contract_flags_by_name_and_regex_with_commas(spark):
    text = (
        "<schema_design>\ndata_title,data_type,data_description,data_example,data_regex\n\n"
        "```EXCLUDE```id,int,,7,^\\d{1,3},\\d+$\nname, string ,\"a, b\",x\nid,int,again,8,^\\d+$\n"
        "more,float\n</schema_design>"
    )
    header = F.array(*map(F.lit, ["A", "B"]))
    rows = [r.asDict() for r in parse_contract(reply(spark, text), header).orderBy("index").collect()]
    assert [r["original_name"] for r in rows] == ["A", "B", "MISSING_ORIGINAL_2", "MISSING_ORIGINAL_3"]
    assert [r["is_excluded"] for r in rows] == [True, False, True, False]
    assert [r["regex"] for r in rows] == [r"^\d{1,3},\d+$", "", r"^\d+$", ""]
    assert (rows[1]["data_type"], rows[1]["description"]) == ("string", "a, b")


def test_parse_contract_unmapped(spark):
    text = "<user_data>\nID,a,b,c\n</user_data><schema_design>\nx,int,,,^1$\n</schema_design>"
    rows = parse_contract(reply(spark, text)).orderBy("index").collect()
    assert [(r["original_name"], r["name"]) for r in rows] == [
        ("a", "x"), ("b", "UNMAPPED_1"), ("c", "UNMAPPED_2"),
    ]


def test_section_is_the_first_and_trimmed(spark):
    df = spark.createDataFrame([("<t>\n one \n</t><t>two</t>",), ("none",), (None,)], "x string")
    assert [r[0] for r in df.select(section("x", "t")).collect()] == ["one", "", ""]


PATCHES = (
    "<semantic_diff>\n... Existing Data ...\n1,\"a, b\",,\"\"\"q\"\"\"\n```FLAGGED: why``` 2,x\n"
    "… Existing Data …\nx,3\n4,\n5,\"whole\"\n</semantic_diff>"
)


def test_parse_row_patches(spark):
    rows = parse_row_patches(reply(spark, PATCHES)).orderBy("seq").collect()
    assert [(r["row_id"], r["values"], r["flagged"], r["seq"]) for r in rows] == [
        (1, ["a, b", "", '"q"'], False, 2), (2, ["x"], True, 3), (4, [""], False, 6),
        (5, ["whole"], False, 7),
    ]


def test_parse_cell_patches(spark):
    df = reply(spark, PATCHES, column="c", source="f")
    rows = parse_cell_patches(df).orderBy("seq").collect()
    assert [(r["row_id"], r["corrected_value"]) for r in rows] == [
        (1, '"a, b",,"""q"""'[1:-1].replace('""', '"')), (4, ""), (5, "whole"),
    ]


def test_parse_decisions(spark):
    text = "<group_3>\n7,a\n</group_3><group_4></group_4><group_5>8</group_5><group_6>9,</group_7>"
    assert [(r["leader_id"], r["keep_id"]) for r in parse_decisions(reply(spark, text)).collect()] == [(3, 7)]


def test_headers_that_become_equal_are_an_error(spark):
    assert clean_headers(spark.createDataFrame([(1, 2)], " a\tb , c°".split(","))).columns == [
        "a b", "c degrees",
    ]
    with pytest.raises(ValueError, match="a b"):
        clean_headers(spark.createDataFrame([(1, 2)], ["a b", " a  b"]))


def test_rename_to_its_own_name_and_by_position(spark):
    df = spark.createDataFrame([(1, "x", "y")], ["row_id", "a", "b"])
    rules = [ColumnRule("a", "a", index=1), ColumnRule("other", "new b", index=2), ColumnRule("z", "q", index=9)]
    assert rename_by_contract(df, rules).columns == ["row_id", "a", "new b"]
    assert rename_by_contract(df, rules, bind="name").columns == ["row_id", "a", "b"]
    assert drop_excluded(df, ["b", "nope"]).columns == ["row_id", "a"]
    with pytest.raises(ValueError):
        rename_by_contract(df, [ColumnRule("a", "b", index=1)])


def test_patterns_search_anywhere_and_bad_ones_pass(spark):
    df = spark.createDataFrame([("xx12",), ("12\n",), ("no",), ("null",), (" ",), (None,)], "v string")

    def passes(pattern, mode="validator"):
        ready = usable_pattern(spark, pattern)
        return [r[0] for r in df.select(matches_contract("v", ready, mode)).collect()]

    assert passes(r"\d+") == [True, True, False, False, True, True]
    assert passes(r"^\w*\d+$") == [True, False, False, False, True, True]
    assert passes(r"\d+", "cleaner") == [True, True, False, True, True, True]
    for pattern in ("", None, "^.*$", "(["):
        assert passes(pattern) == [True] * 6


def test_empty_words_by_mode(spark):
    words = ["", "  \t", "NaN", "nan", "undefined", "null", "NULL", "Null", "0", None]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    got = [tuple(r) for r in df.select(is_empty("v"), is_empty("v", "cleaner")).collect()]
    assert got == [*[(True, True)] * 5, *[(False, True)] * 2, (False, False), (False, False), (True, True)]


def test_leading_number(spark):
    texts = ["12abc", " -1.5e2x", ".5", "5.", "-", "", "abc", None, "1e", "Infinity", "+7"]
    df = spark.createDataFrame([(t,) for t in texts], "v string")
    got = [r[0] for r in df.select(leading_number("v")).collect()]
    assert got == [12.0, -150.0, 0.5, 5.0, 0.0, 0.0, 0.0, 0.0, 1.0, float("inf"), 7.0]


def test_validation_counts(spark):
    df = spark.createDataFrame([(1, "5", "a"), (2, "x", "b"), (3, "null", "c"), (4, None, "d")], "row_id long, n string, t string")
    rules = [ColumnRule("n", "n", index=1, regex=r"^\d+$"), ColumnRule("t", "t", index=2), ColumnRule("u", "u", index=3, regex="x")]
    stats = {r["column"]: r for r in validation_stats(df, rules).collect()}
    assert set(stats) == {"n", "t"}
    n = stats["n"]
    assert (n["total_count"], n["valid_count"], n["invalid_count"], n["empty_count"]) == (4, 2, 2, 1)
    assert (n["valid_pct"], stats["t"]["valid_pct"]) == (50.0, 100.0)
    assert {(r["row_id"], r["value"]) for r in invalid_cells(df, rules).collect()} == {(2, "x"), (3, "null")}
    assert validation_stats(df, []).isEmpty()


def patterned(n=400):
    rng = random.Random(6)
    rows = []
    for i in range(n):
        phone = f"+1 ({rng.randrange(200, 999)}) {rng.randrange(100, 999)}-{rng.randrange(1000, 9999)}" if i % 3 else f"1-{rng.randrange(10**9, 10**10)}"
        code = f"AB-{rng.choice('XYZ')}{rng.choice('pq')}{rng.randrange(100)}"
        note = " ".join("".join(rng.choice("abcDEF ,.;") for _ in range(rng.randrange(1, 12))) for _ in range(3))
        rows.append((phone, code, f"Customer#{i:09d}", note, None if i % 5 else "", rng.choice(["é-1", "é-22", r"\d+", "a|b"])))
    return rows


def test_induced_patterns_accept_all_rows_and_reject_others(spark):
    rows = patterned()
    names = ["phone", "code", "id", "note", "none", "odd"]
    df = spark.createDataFrame(rows, ", ".join(f"{c} string" for c in names)).repartition(3)
    found = {r["original_name"]: r for r in induced_patterns(df, names).collect()}
    assert set(found) == {"phone", "code", "id", "odd"}
    for k, name in enumerate(names):
        if name in found:
            regex = re.compile(found[name]["regex"])
            assert all(regex.fullmatch(r[k]) for r in rows)
            assert df.filter(F.col(name).rlike(found[name]["regex"])).count() == len(rows)
    assert found["id"]["regex"] == r"^Customer\#[0-9]{9}$" and found["phone"]["shapes"] == 2
    bad = {
        "phone": ["+1 (12) 345-6789", "+2 (212) 345-6789", "1-123456789", "x1-1234567890", "1 1234567890"],
        "code": ["AC-Xp1", "AB-XP1", "AB-Xp", "AB-Xp123", "ab-xp1"],
        "id": ["Customer#00000001", "Supplier#000000001", "Customer 000000001", "Customer#0000000011"],
        "odd": ["d+", "a", "ab", "é-", "e-1"],
    }
    for name, values in bad.items():
        assert not any(re.search(found[name]["regex"], v) for v in values), name


def test_learned_patterns_replace_the_catch_all_of_text_only(spark):
    df = spark.createDataFrame([(str(i), f"AB-{i:05d}", f"w{'x' * (i % 37)} {i}" * (i % 5)) for i in range(300)], "n string, code string, free string")
    plain = {r["original_name"]: r for r in propose_contract(df, df.columns).collect()}
    learned = {r["original_name"]: r for r in propose_contract(df, df.columns, learn_patterns=True).collect()}
    assert learned["n"] == plain["n"] and plain["code"]["regex"] == "^.*$"
    assert learned["code"]["regex"] == r"^AB\-[0-9]{5}$"
    assert induced_patterns(df.limit(0), df.columns).count() == 0 and induced_patterns(df, []).count() == 0


def test_runs_of_values_are_added_up_before_spark_sorts_them(spark, monkeypatch):
    """Smallest and largest texts need a sort, which must not hold a row per run of each value."""
    df = spark.range(4000, numPartitions=2).selectExpr("concat('AB-', id % 97, '/', id) AS code", "cast(id AS string) AS n")
    df = df.union(spark.createDataFrame([("ab ", None), (None, ""), ("é-7", "12")], "code string, n string"))
    found = induced_patterns(df, df.columns)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "posexplode" not in plan
    want = sorted(map(tuple, found.collect()))
    assert [r[1] for r in want if r[0] == "n"] == [r"^[0-9]{1,4}$"]
    monkeypatch.setattr("sparkscour.operators.patterns.HELD_RUNS", 1)
    assert sorted(map(tuple, induced_patterns(df.repartition(7), df.columns).collect())) == want
