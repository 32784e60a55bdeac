"""Token-bounded batches of invalid cells, and the hooks that send them to a corrector."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.functions.text import csv_quote, tokens_of
from sparkscour.operators.reply_text import DESIGN_HEADER
from sparkscour.operators.rows import distributed_rank
from sparkscour.session import durable, join_hot
from sparkscour.sources.contracts import Contract, rules_of

# Defaults of the batch plan.
TOKEN_LIMIT = 500_000
PROMPT_TOKENS = 2000
# Lines whose running lengths are summed by one task, and stretches or blocks that are summed above them.
STRETCH = 10_000
FAN = 1000

CALL_SCHEMA = (
    "row_id bigint, column string, corrected_value string, source string, seq bigint, "
    "batch int, cells bigint, error string"
)
CALL_COLUMNS = [c.split()[0] for c in CALL_SCHEMA.split(", ")]


def plan_batches(
    cells: DataFrame,
    token_limit: int = TOKEN_LIMIT,
    overhead: int = PROMPT_TOKENS,
    max_batches: int | None = None,
    schema_text: Column | None = None,
    example_text: Column | None = None,
) -> DataFrame:
    """Number the cells ``(row_id, column, value)`` of each column into contiguous batches.

    One batch if the whole column fits the limit; otherwise the smallest number of equal batches,
    two or more, whose first batch fits. A later batch that is above the limit is cut where its
    running length passes it, so that all batches fit; only a single line may be too long by
    itself. With ``max_batches`` there are at most so many, and they are not cut. Adds ``batch``
    and ``batches``. ``schema_text`` and ``example_text`` are the texts sent along, as functions of
    ``column``.
    """
    none = F.lit("")
    line_chars = F.length(F.concat_ws(",", F.col("row_id").cast("string"), csv_quote("value"))) + 1
    ranked = distributed_rank(
        cells.withColumn("_chars", line_chars.cast("long")), ["row_id"], within=["column"], rank_col="_rank"
    )
    # Prompt parts around the lines: labels (fixed values), the two texts and the CSV header.
    fixed = (
        F.lit(len("Schema: ") + len("\nSemantic Diff: ") + len("\nData: "))
        + F.length(F.coalesce(schema_text if schema_text is not None else none, none))
        + F.length(F.coalesce(example_text if example_text is not None else none, none))
        + F.length(F.concat(F.lit("ID,"), F.col("column")))
    )
    # Characters of lines that fit: tokens are a quarter of all characters, rounded up.
    room = F.lit(4 * (token_limit - overhead)) - fixed
    summed = _running(ranked.withColumn("_stretch", F.floor(F.col("_rank") / STRETCH)))
    sizes = summed.groupBy("column").agg(
        F.count(F.lit(1)).alias("_n"),
        F.sum("_chars").alias("_all"),
        F.max("_chars").alias("_longest"),
        F.count_if(F.col("_until") <= room).alias("_fitting"),
    )
    n, fitting = F.col("_n"), F.greatest(F.col("_fitting"), F.lit(1))
    equal = F.when(F.col("_all") <= room, F.lit(1)).otherwise(F.greatest(F.ceil(n / fitting), F.lit(2)))
    if max_batches is not None:
        equal = F.least(equal, F.lit(max_batches))
    plan = sizes.select("column", "_n", "_longest", equal.alias("_equal"))
    per_batch = F.ceil(n / F.col("_equal"))
    dealt = join_hot(summed, plan, "column", spread_by=F.col("row_id"), measured=ranked).withColumn(
        "_batch", F.ceil(F.col("_rank") / per_batch).cast("long")
    )
    if max_batches is not None:
        return dealt.select(
            *cells.columns, F.col("_batch").cast("int").alias("batch"), F.col("_equal").cast("int").alias("batches")
        )
    batch = ["column", "_batch"]
    lengths = dealt.groupBy(*batch).agg(
        F.min(F.col("_until") - F.col("_chars")).alias("_start"), F.sum("_chars").alias("_size")
    )
    # A line starts a new part where the lines before it fill one, less the longest line.
    step = F.greatest(room - F.col("_longest"), F.lit(1))
    before = F.col("_until") - F.col("_chars") - F.col("_start")
    part = F.when(F.col("_size") > room, F.floor(before / step)).otherwise(F.lit(0))
    # A batch is bounded by its tokens, more or less, so no key is hot from here on.
    cut = dealt.join(lengths, batch).withColumn("_part", part)
    # One row per batch and part; numbers run through the parts, first inside a batch.
    named = durable(cut.groupBy(*batch, "_part").agg(F.count(F.lit(1)).alias("_lines")))
    parts = named.groupBy(*batch).agg(F.count(F.lit(1)).alias("_sum"))
    starts = sums_before(parts.select("column", F.col("_batch").alias("_stretch"), "_sum"))
    totals = parts.groupBy("column").agg(F.sum("_sum").cast("int").alias("batches"))
    inside = F.row_number().over(Window.partitionBy(*batch).orderBy("_part"))
    numbered = (
        named.withColumn("_inside", inside)
        .join(starts.withColumnRenamed("_stretch", "_batch"), batch)
        .join(totals, "column")
        .select(*batch, "_part", (F.col("_before") + F.col("_inside")).cast("int").alias("batch"), "batches")
    )
    return cut.join(numbered, [*batch, "_part"]).select(*cells.columns, "batch", "batches")


def sums_before(sums: DataFrame) -> DataFrame:
    """``column``, ``_stretch`` and ``_before``, the ``_sum`` of all earlier stretches of the column.

    A tree of sums: blocks of ``FAN`` stretches are summed, blocks of blocks above them, and so on up to
    one block. On the way down each stretch adds what stands before it in its block to what stands before
    the block. No task sees more than ``FAN`` sums in order, however long a column is.
    """
    last = sums.agg(F.max("_stretch")).first()[0] or 0
    blocked = sums.withColumn("_block", F.floor(F.col("_stretch") / FAN))
    earlier = Window.partitionBy("column", "_block").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    inside = blocked.withColumn("_inside", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)))
    if last < FAN:
        return inside.select("column", "_stretch", F.col("_inside").alias("_before"))
    above = blocked.groupBy("column", F.col("_block").alias("_stretch")).agg(F.sum("_sum").alias("_sum"))
    starts = sums_before(durable(above)).select("column", F.col("_stretch").alias("_block"), F.col("_before").alias("_start"))
    return inside.join(starts, ["column", "_block"]).select(
        "column", "_stretch", (F.col("_start") + F.col("_inside")).alias("_before")
    )


def _running(ranked: DataFrame) -> DataFrame:
    """Adds ``_until``, the characters of a column up to and with each line, by stretches of lines."""
    stretch = ["column", "_stretch"]
    sums = durable(ranked.groupBy(*stretch).agg(F.sum("_chars").alias("_sum")))
    here = Window.partitionBy(*stretch).orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    inside = ranked.withColumn("_inside", F.sum("_chars").over(here))
    return inside.join(sums_before(sums), stretch).withColumn("_until", F.col("_before") + F.col("_inside")).drop(
        "_before", "_inside", "_stretch"
    )


def ask_corrector(
    invalid: DataFrame,
    contract: Contract,
    corrector: Callable[[pd.DataFrame, dict], pd.DataFrame],
    instructions: str | None = None,
    examples: dict[str, str] | None = None,
    **plan: int,
) -> tuple[DataFrame, DataFrame]:
    """Cell patches from a user-supplied corrector, and the calls that failed.

    ``corrector(cells, context)`` gets ``row_id`` and ``value`` of invalid cells of one column
    batch and returns ``row_id`` and ``corrected_value``; the context has the column's rule, its
    schema text with the header line, the example corrections given for the column, the batch
    number and the instructions. All of these count towards the token limit. A failed call leaves
    no patches but a row in the second table: ``column``, ``batch``, ``cells`` and ``error``. Both
    come from one checkpointed pass, so no cell is sent twice.
    """
    examples = examples or {}
    rules = {r.name: vars(r) for r in rules_of(contract)}
    schemas = {r.name: f"{DESIGN_HEADER}\n{_rule_line(r)}" for r in rules_of(contract)}

    def texts(known: dict[str, str]) -> Column:
        chosen = F.lit("")
        for column, text in known.items():
            chosen = F.when(F.col("column") == F.lit(column), F.lit(text)).otherwise(chosen)
        return chosen

    planned = plan_batches(
        invalid.filter(F.col("column").isin(*rules)),
        schema_text=texts(schemas),
        example_text=texts(examples),
        **plan,
    )

    def one_call(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        column, batch = key
        context = {
            "rule": rules[column],
            "schema": schemas[column],
            "examples": examples.get(column, ""),
            "batch": int(batch),
            "instructions": instructions,
        }
        cells = pdf[["row_id", "value"]].sort_values("row_id", ignore_index=True)
        made = {"column": column, "source": f"{column}_batch_{batch}", "batch": int(batch), "cells": len(cells)}
        try:
            fixed = corrector(cells, context)
            patches = pd.DataFrame(
                {"row_id": fixed["row_id"].to_numpy(), "corrected_value": fixed["corrected_value"].to_numpy()}
            ).assign(seq=range(1, len(fixed) + 1), error=None, **made)
        except Exception as error:  # whatever a user's hook raises is reported with its call
            failed = {"row_id": None, "corrected_value": None, "seq": None, "error": f"{type(error).__name__}: {error}"}
            patches = pd.DataFrame([failed]).assign(**made)
        kinds = {c: object for c in ("column", "corrected_value", "source", "error")}
        return patches.astype({**kinds, "row_id": "Int64", "seq": "Int64"})[CALL_COLUMNS]

    answers = planned.groupBy("column", "batch").applyInPandas(one_call, CALL_SCHEMA)
    answers = durable(answers)
    patches = answers.filter("error IS NULL").select("row_id", "column", "corrected_value", "source", "seq")
    return patches, answers.filter("error IS NOT NULL").select("column", "batch", "cells", "error")


def correct_cells(
    invalid: DataFrame,
    contract: Contract,
    corrector: Callable[[pd.DataFrame, dict], pd.DataFrame],
    instructions: str | None = None,
    examples: dict[str, str] | None = None,
    **plan: int,
) -> DataFrame:
    """The patches of ``ask_corrector`` alone."""
    return ask_corrector(invalid, contract, corrector, instructions, examples, **plan)[0]


def _rule_line(rule: object) -> str:
    return ",".join([rule.name, rule.data_type, rule.description, rule.example, rule.regex])


def ask_decider(
    requests: DataFrame, decider: Callable[[str], str | None], text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """Replies ``(leader_id, part, text)`` of a user-supplied decider, and the calls that failed.

    A failed call has no reply but a row ``(leader_id, part, error)`` in the second table.
    """

    def replies(chunks: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in chunks:
            answers, errors = [], []
            for request in pdf["text"]:
                try:
                    answer, error = decider(request), None
                except Exception as raised:  # whatever a user's hook raises is reported
                    answer, error = None, f"{type(raised).__name__}: {raised}"
                answers.append(answer)
                errors.append(error)
            yield pdf.assign(
                text=pd.Series(answers, index=pdf.index, dtype="object"),
                error=pd.Series(errors, index=pdf.index, dtype="object"),
            )

    asked = requests.select("leader_id", "part", F.col(text).alias("text"))
    schema = "leader_id bigint, part bigint, text string, error string"
    answers = durable(asked.mapInPandas(replies, schema))
    failed = answers.filter("error IS NOT NULL").select("leader_id", "part", "error")
    return answers.filter("text IS NOT NULL").drop("error"), failed


def decide_groups(
    requests: DataFrame, decider: Callable[[str], str | None], text: str = "text"
) -> DataFrame:
    """The replies of ``ask_decider`` alone."""
    return ask_decider(requests, decider, text)[0]
