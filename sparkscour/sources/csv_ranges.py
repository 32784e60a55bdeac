"""CSV files with line breaks inside quotes, read by many tasks per file.

Whether a byte of such a file stands inside quotes depends on all quotes before it, so a task can't
tell where a record starts. But only the parity of their number counts, and parities add up: one scan
counts the quotes of each range of the file, sums over the ranges say whether a range starts inside
quotes, and then each task knows which of its lines start a record. A record that goes on past its range
leaves pieces, at most two per range, which are put together at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.session import durable

PIECES = "_file string, _block long, _pos long, kind int, first boolean, text string"
# Kinds of pieces, in the order in which those of one range follow each other: the end of an earlier
# record, lines that are all inside one, a whole record, and a record that goes on.
END, MIDDLE, WHOLE, OPEN = range(4)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """The lines of the files with their quotes and their range, in which they come in order."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"'), F.lit("")))
    return spark.read.text(path, lineSep="\n").select(
        "value",
        quotes.cast("int").alias("quotes"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
    )


def _starts(lines: DataFrame) -> DataFrame:
    """Whether each range starts inside quotes."""
    odd = durable(lines.groupBy("_file", "_block").agg((F.sum("quotes") % 2).alias("odd")))
    before = Window.partitionBy("_file").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("odd").over(before), F.lit(0)) % 2 == 1
    return odd.select("_file", "_block", inside.alias("inside"))


def pieces_of(lines: list[str], quotes: np.ndarray, inside: bool) -> list[tuple[int, int, str]]:
    """``(kind, first line, text)`` of the records and pieces of a range."""
    after = (np.cumsum(quotes) + inside) % 2
    starts = np.flatnonzero(np.r_[inside, after[:-1] == 1] == 0)
    cuts = [*starts.tolist(), len(lines)]
    out = []
    if cuts[0] > 0:
        # No record starts before the first one is over; without any start, none is over.
        over = len(starts) > 0 or after[-1] == 0
        out.append((END if over else MIDDLE, 0, "\n".join(lines[: cuts[0]])))
    for a, b in zip(cuts, cuts[1:]):
        text = lines[a] if b == a + 1 else "\n".join(lines[a:b])
        out.append((OPEN if b == len(lines) and after[-1] == 1 else WHOLE, a, text))
    return out


class _Range:
    """Puts the lines of one range together, over the batches in which they come."""

    def __init__(self, file: str, block: int, inside: bool):
        self.file, self.block, self.inside = file, block, inside
        self.held: list[str] = []  # lines of the record that is open
        self.began = False  # whether some record started in this range
        self.header = block == 0  # whether the file's header is still to come
        self.n = 0  # rows so far: their numbers have no gaps

    def add(self, lines: list[str], quotes: np.ndarray) -> Iterator[tuple]:
        for kind, _, text in pieces_of(lines, quotes, self.inside):
            if kind in (MIDDLE, OPEN):
                self.held.append(text)
                self.began |= kind == OPEN
                continue
            if kind == END:
                text = "\n".join([*self.held, text])
                self.held = []
            if kind == END and not self.began:
                self.began = True
                yield self.row(END, text)
                continue
            self.began = True
            if text not in ("", "\r"):
                if not self.header:
                    yield self.row(WHOLE, text)
                    self.n += 1
                self.header = False
        self.inside = bool((int(quotes.sum()) + self.inside) % 2)

    def rest(self) -> Iterator[tuple]:
        if self.held:
            yield self.row(OPEN if self.began else MIDDLE, "\n".join(self.held))

    def row(self, kind: int, text: str) -> tuple:
        return self.file, self.block, self.n, kind, kind == OPEN and self.header, text


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records and pieces of each range; a task reads its ranges one after the other."""
    types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.string()]
    names = [c.split(" ")[0] for c in PIECES.split(", ")]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows) if rows else [[]] * len(types)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    now: _Range | None = None
    for batch in batches:
        rows: list[tuple] = []
        files, blocks = batch.column(2), batch.column(3)
        moved = pc.or_(pc.not_equal(files[1:], files[:-1]), pc.not_equal(blocks[1:], blocks[:-1]))
        edges = [0, *(np.flatnonzero(moved.to_numpy(zero_copy_only=False)) + 1).tolist(), batch.num_rows]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            file, block = files[a].as_py(), blocks[a].as_py()
            if now is None or (now.file, now.block) != (file, block):
                rows.extend(now.rest() if now else [])
                now = _Range(file, block, batch.column(4)[a].as_py())
            part = batch.slice(a, b - a)
            rows.extend(now.add(part.column(0).to_pylist(), part.column(1).to_numpy()))
        yield out(rows)
    yield out(list(now.rest()) if now else [])


def records(spark: SparkSession, path: str) -> DataFrame:
    """``_file``, ``_block``, ``_pos`` and ``text`` of all records but blank ones and the files' headers."""
    lines = _lines(spark, path)
    # One row per range of a file, so a table of any size has few.
    known = lines.join(F.broadcast(_starts(lines)), ["_file", "_block"])
    columns = ("value", "quotes", "_file", "_block", "inside")
    pieces = known.select(*columns).mapInArrow(_cut, PIECES)
    whole = pieces.filter(F.col("kind") == WHOLE)
    # The others are at most two per range; a record of many ranges is one row here as anywhere.
    others = durable(pieces.filter(F.col("kind") != WHOLE))
    order = Window.partitionBy("_file").orderBy("_block", "kind")
    named = others.withColumn("record", F.count_if(F.col("kind") == OPEN).over(order))
    piece = F.struct("_block", "kind", "_pos", "first", "text")
    joined = named.groupBy("_file", "record").agg(F.sort_array(F.collect_list(piece)).alias("p"))
    start = F.get("p", F.lit(0))
    stitched = joined.select(
        "_file", start["_block"].alias("_block"), start["_pos"].alias("_pos"), start["first"].alias("first"),
        F.array_join(F.col("p")["text"], "\n").alias("text"),
    )
    both = whole.select("_file", "_block", "_pos", "text").unionByName(stitched.filter(~F.col("first")).drop("first"))
    broken = F.replace("text", F.lit("\r\n"), F.lit("\n"))
    return both.withColumn("text", F.regexp_replace(broken, r"\r$", ""))


def read_csv_ranges(spark: SparkSession, path: str, columns: list[str], options: dict[str, object]) -> DataFrame:
    """The rows of CSV files with a header, as strings, with ``_file``, ``_block`` and ``_pos``.

    Lines end in a line feed, or a carriage return before it, which is a line feed inside quotes too; a
    carriage return by itself is text.
    """
    schema = ", ".join("`" + c.replace("`", "``") + "` string" for c in columns)
    texts = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in options.items()}
    parsed = records(spark, path).select("*", F.from_csv("text", schema, texts).alias("_row"))
    cells = [F.col("_row").getField(c).alias(c) for c in columns]
    return parsed.select(*cells, "_file", "_block", "_pos")
