"""Patterns of columns learned from their values, by description length.

A value is a series of runs: digits, upper-case letters, lower-case letters, and single other characters.
Its shape leaves the lengths of the runs out. Each shape of a column becomes one branch of a regular
expression: a run that never differs is spelt out, any other is its class with the lengths that were seen.
The expression is taken if it and what it leaves open are together shorter, in bits, than the values
written out as plain text; else the column is free text. Counts, lengths and smallest and largest runs
add up, so a task sends one row per shape and run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col
from sparkscour.functions.validity import is_empty

RUN = "[0-9]+|[A-Z]+|[a-z]+|[^0-9A-Za-z]"
# Classes of runs, the sign that stands for one in a shape, and their numbers of characters.
CLASSES = (("[0-9]", "0", 10), ("[A-Z]", "A", 26), ("[a-z]", "a", 26))
# Characters that text may have, and bits of a character of a pattern.
TEXT_CHARACTERS = 95
PATTERN_BITS = 8
# Branches of a pattern at most; columns with far more shapes by an estimate aren't looked at closer.
MOST_SHAPES = 8
# Shapes and runs that a task holds before it sends what it has seen of them.
HELD_RUNS = 50_000
SEEN = "original_name string, shape string, place int, n long, shortest int, longest int, chars long, first string, last string"


def shape_of(value: Column) -> Column:
    for chars, sign, _ in CLASSES:
        value = F.regexp_replace(value, f"{chars}+", sign)
    return value


def _filled(name: str) -> Column:
    text = as_col(name).cast("string")
    return F.when(~is_empty(text, "unified"), text)


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([!-/:-@\[-`{-~])", r"\\$1")


def _piece(shortest: Column, longest: Column, first: Column, last: Column) -> Column:
    """The part of a pattern for a run of one shape."""
    some = F.lit(None).cast("string")
    for chars, _, _ in CLASSES:
        some = F.when(first.rlike(f"^{chars}"), F.lit(chars)).otherwise(some)
    low, high = shortest.cast("string"), longest.cast("string")
    times = (
        F.when(longest == 1, F.lit(""))
        .when(shortest == longest, F.concat(F.lit("{"), low, F.lit("}")))
        .otherwise(F.concat(F.lit("{"), low, F.lit(","), high, F.lit("}")))
    )
    return F.when(first == last, _escaped(first)).otherwise(F.concat(some, times))


def _bits(n: Column, shortest: Column, longest: Column, chars: Column, first: Column, last: Column) -> Column:
    """What a run of one shape leaves open: its lengths and its characters."""
    each = F.lit(0.0)
    for kind, _, size in CLASSES:
        each = F.when(first.rlike(f"^{kind}"), F.log2(F.lit(float(size)))).otherwise(each)
    return F.when(first == last, F.lit(0.0)).otherwise(n * F.log2((longest - shortest + 1).cast("double")) + chars * each)


def _seen() -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Counts, lengths, smallest and largest text of each shape and run, from rows of a name, a shape and its runs.

    A closure, so executors need no module.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = [f.split() for f in SEEN.split(", ")]
        kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
        held: dict[tuple[str, str, int], list] = {}

        def emit() -> pa.RecordBatch:
            columns = list(zip(*((*key, *seen) for key, seen in held.items())))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [name for name, _ in fields])

        for batch in batches:
            names, shapes, runs = (batch.column(i) for i in range(3))
            coded = [c.dictionary_encode() for c in (names, shapes)]
            name, shape = (c.indices.to_numpy() for c in coded)
            group = name.astype(np.int64) * max(len(coded[1].dictionary), 1) + shape
            order = np.argsort(group, kind="stable")
            cuts = np.flatnonzero(np.diff(group[order])) + 1
            starts, texts = runs.offsets.to_numpy(), runs.values
            for rows in np.split(order, cuts) if len(order) else []:
                key = coded[0].dictionary[name[rows[0]]].as_py(), coded[1].dictionary[shape[rows[0]]].as_py()
                sizes = starts[rows + 1] - starts[rows]
                for place in range(int(sizes.max())):
                    found = texts.take(pa.array(starts[rows[sizes > place]] + place))
                    lengths, ends = pc.utf8_length(found).to_numpy(), pc.min_max(found)
                    now = [len(found), int(lengths.min()), int(lengths.max()), int(lengths.sum()), ends["min"].as_py(), ends["max"].as_py()]
                    was = held.get((*key, place))
                    if was is not None:
                        now = [how(x, y) for how, x, y in zip((int.__add__, min, max, int.__add__, min, max), was, now)]
                    held[(*key, place)] = now
            if len(held) >= HELD_RUNS:
                yield emit()
        if held:
            yield emit()

    return run


def induced_patterns(df: DataFrame, columns: Sequence[str], most_shapes: int = MOST_SHAPES) -> DataFrame:
    """``original_name``, ``regex``, ``shapes`` and ``filled_count`` of the columns that have a pattern.

    The pattern matches every filled value of its column. Columns of free text, without values, or with
    more than ``most_shapes`` shapes give no row.
    """
    columns = list(columns)
    schema = "original_name string, regex string, shapes long, filled_count long"
    guessed = df.agg(*[F.approx_count_distinct(shape_of(_filled(c))).alias(f"s{i}") for i, c in enumerate(columns)]).first() if columns else {}
    chosen = [c for i, c in enumerate(columns) if 0 < guessed[f"s{i}"] <= 4 * most_shapes]
    if not chosen:
        return df.sparkSession.createDataFrame([], schema)
    named = [F.struct(F.lit(c).alias("original_name"), _filled(c).alias("value")) for c in chosen]
    cells = df.select(F.inline(F.array(*named))).filter("value IS NOT NULL")
    runs = cells.select("original_name", shape_of(F.col("value")).alias("shape"), F.regexp_extract_all("value", F.lit(RUN), F.lit(0)).alias("runs"))
    # Spark sorts all rows to find smallest and largest texts, so tasks add up what they hold before.
    seen = runs.mapInArrow(_seen(), SEEN).groupBy("original_name", "shape", "place").agg(
        F.sum("n").alias("n"), F.min("shortest").alias("shortest"), F.max("longest").alias("longest"),
        F.sum("chars").alias("chars"), F.min("first").alias("first"), F.max("last").alias("last"),
    )
    shortest, longest, first, last = (F.col(c) for c in ("shortest", "longest", "first", "last"))
    pieces = seen.withColumn("piece", _piece(shortest, longest, first, last)).withColumn(
        "bits", _bits(F.col("n"), shortest, longest, F.col("chars"), first, last)
    )
    # A branch has as many pieces as its shape has signs, a column at most so many branches.
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "piece"))), lambda p: p["piece"]), "")
    branches = pieces.groupBy("original_name", "shape").agg(
        F.max("n").alias("n"), F.sum("chars").alias("chars"), F.sum("bits").alias("bits"), joined.alias("branch")
    )
    known = branches.groupBy("original_name").agg(F.count(F.lit(1)).alias("shapes"), F.sum("n").alias("filled_count"))
    few = branches.join(known.filter(F.col("shapes") <= most_shapes), "original_name")
    choice = F.col("n") * F.log2(F.col("filled_count") / F.col("n"))
    order = F.sort_array(F.collect_list(F.struct((-F.col("n")).alias("n"), "shape", "branch")))
    found = few.groupBy("original_name", "shapes", "filled_count").agg(
        F.array_join(F.transform(order, lambda b: b["branch"]), "|").alias("branches"),
        F.sum(F.col("bits") + choice).alias("bits"),
        F.sum("chars").alias("chars"),
    )
    several = F.concat(F.lit("^(?:"), F.col("branches"), F.lit(")$"))
    regex = F.when(F.col("shapes") > 1, several).otherwise(F.concat(F.lit("^"), F.col("branches"), F.lit("$")))
    shorter = F.length("regex") * PATTERN_BITS + F.col("bits") < F.col("chars") * F.log2(F.lit(float(TEXT_CHARACTERS)))
    return found.withColumn("regex", regex).filter(shorter).select("original_name", "regex", "shapes", "filled_count")
