import random

import numpy as np
import pytest

from sparkscour.operators.rows import distributed_rank, head_sample, with_row_id
from sparkscour.sources.contracts import ColumnRule, contract_frame, read_contract, rules_of, write_contract
from sparkscour.sources.csv_ranges import END, MIDDLE, OPEN, WHOLE, pieces_of
from sparkscour.sources.exclusions import read_exclusions
from sparkscour.sources.replies import read_replies
from sparkscour.sources.tables import read_table, write_splits, write_table


def test_csv_reads_strings_and_skips_blank_lines(spark, tmp_path):
    (tmp_path / "in.csv").write_text('a,b\n1,"x, ""y"""\n\n2,"two\nlines"\n3\n')
    df = read_table(spark, str(tmp_path / "in.csv"))
    assert [t for _, t in df.dtypes] == ["string", "string"]
    assert [tuple(r) for r in df.collect()] == [("1", 'x, "y"'), ("2", "two\nlines"), ("3", None)]


def test_csv_round_trip_and_input_guard(spark, tmp_path):
    rows = [("a,b", 'q"q'), ("two\nlines", None), (" edge ", "")]
    path = str(tmp_path / "out")
    write_table(spark.createDataFrame(rows, "a string, `b c` string"), path)
    back = {tuple(r) for r in read_table(spark, path).collect()}
    assert back == {("a,b", 'q"q'), ("two\nlines", None), (" edge ", None)}
    with pytest.raises(ValueError):
        write_table(spark.range(1), path + "/../out/", source_path="file://" + path)


def messy_csv(seed, n):
    """Quoted cells with breaks, doubled quotes and blank lines, some of them long; ends with or without a break."""
    rng = random.Random(seed)
    cells = ["a", "", "x y", '"q"', '"two\nlines"', '"a ""b"" c"', '"\n\n"', '",\n"",\n"', '""', '"' + "l\n" * 150 + '"', " e "]
    out = ["k,b c,d"]
    for i in range(n):
        out.append(",".join([str(i), *rng.choices(cells, weights=[9] * 9 + [1, 9], k=rng.choice([1, 2, 2, 2, 3]))]))
        if rng.random() < 0.1:
            out.append("")
    return "\n".join(out) + rng.choice(["", "\n", "\n\n"])


@pytest.mark.parametrize("size,lines", [("60", "\n"), ("700b", "\r\n"), ("1k", "\n")])
def test_ranges_of_a_file_give_the_rows_of_the_whole_file(spark, tmp_path, size, lines):
    for k in range(2):
        (tmp_path / f"{k}.csv").write_bytes(messy_csv(k, 120).replace("\n", lines).encode())
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    want = sorted(map(str, spark.read.csv(str(tmp_path), header=True, multiLine=True, quote='"', escape='"').collect()))
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        df = read_table(spark, str(tmp_path), with_position=True)
        blocks = {(r["_file"], r["_block"]) for r in df.select("_file", "_block").distinct().collect()}
        assert sorted(map(str, df.drop("_file", "_block", "_pos").collect())) == want and len(want) == 240
        assert len(blocks) > 4
        rows = with_row_id(df).orderBy("row_id").collect()
        assert [int(r["k"]) for r in rows] == [*range(120)] * 2
        plain = read_table(spark, str(tmp_path), ranges=False)
        assert sorted(map(str, plain.collect())) == want
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_pieces_of_a_range():
    lines = ['a"', "b", 'c"', "d", '"e', "f"]
    quotes = np.array([x.count('"') for x in lines])
    assert pieces_of(lines, quotes, False) == [(WHOLE, 0, 'a"\nb\nc"'), (WHOLE, 3, "d"), (OPEN, 4, '"e\nf')]
    assert pieces_of(lines, quotes, True) == [(END, 0, 'a"'), (WHOLE, 1, "b"), (WHOLE, 2, 'c"\nd\n"e'), (WHOLE, 5, "f")]
    assert pieces_of(["x", "y"], np.array([0, 0]), True) == [(MIDDLE, 0, "x\ny")]
    assert pieces_of(["x", 'y"'], np.array([0, 1]), True) == [(END, 0, 'x\ny"')]


def test_an_open_quote_at_the_end_and_an_empty_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v\n1,"never\nclosed\n')
    rows = read_table(spark, str(tmp_path / "a.csv"), ranges=True).collect()
    assert [r["k"] for r in rows] == ["1"]
    (tmp_path / "b.csv").write_text("k,v\n")
    assert read_table(spark, str(tmp_path / "b.csv"), ranges=True).count() == 0


def test_file_order_row_ids(spark, tmp_path):
    for i in range(3):
        lines = "\n".join(f"{i}-{j}" for j in range(50))
        (tmp_path / f"part-{i}.csv").write_text("v\n" + lines + "\n")
    df = with_row_id(read_table(spark, str(tmp_path), with_position=True))
    got = [(r["row_id"], r["v"]) for r in df.orderBy("row_id").collect()]
    assert got == [(i * 50 + j + 1, f"{i}-{j}") for i in range(3) for j in range(50)]
    assert [r["line"] for r in head_sample(df, 2).collect()] == ["1,0-0", "2,0-1"]


def test_rank_does_not_depend_on_partitions(spark):
    rows = [(i % 3, (i * 37) % 1009, i) for i in range(1009)]
    df = spark.createDataFrame(rows, "g int, k int, i int")
    want = {}
    for g in range(3):
        for rank, (k, i) in enumerate(sorted((k, i) for h, k, i in rows if h == g), start=1):
            want[i] = rank
    for n in (1, 7):
        ranked = distributed_rank(df.repartition(n), ["k", "i"], within=["g"])
        assert {r["i"]: r["rank"] for r in ranked.collect()} == want


def test_exclusions(spark, tmp_path):
    (tmp_path / "x.txt").write_text("# note\n\n ID \nraw\nraw\n")
    assert {r[0] for r in read_exclusions(spark, str(tmp_path / "x.txt")).collect()} == {"ID", "raw"}
    assert read_exclusions(spark, str(tmp_path / "none.txt")).isEmpty()
    assert read_exclusions(spark, None).isEmpty()


def test_contract_file_round_trip(spark, tmp_path):
    rules = [
        ColumnRule('a "b"', "x", True, False, 1, "int", "d,e", "1", r"^\d{1,3},\d+$"),
        ColumnRule("c", "y z", False, True, 2),
    ]
    write_contract(contract_frame(spark, rules), str(tmp_path / "contract"))
    assert rules_of(read_contract(spark, str(tmp_path / "contract"))) == rules


def test_replies(spark, tmp_path):
    for name in ("full name_output.txt", "mail_batch_2_output.txt", "ignored.log"):
        (tmp_path / name).write_text("text of\n" + name)
    got = {(r["source"], r["column"]) for r in read_replies(spark, str(tmp_path)).collect()}
    assert got == {("full name_output.txt", "full name"), ("mail_batch_2_output.txt", "mail")}


def test_empty_split_writes_nothing(spark, tmp_path):
    df = spark.createDataFrame([(1, "train"), (2, "test")], "a int, split string")
    write_splits(df, str(tmp_path / "s"), "parquet")
    assert sorted(p.name for p in (tmp_path / "s").iterdir() if p.is_dir()) == ["split=test", "split=train"]
