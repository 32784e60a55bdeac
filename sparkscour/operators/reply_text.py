"""Reply text to tables: contract lines, row and cell corrections, group decisions.

A reply table has one row per reply with a ``text`` column; other columns are carried along, so
any number of replies is parsed in one job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.text import as_col, csv_fields, trim_space, unquote

# Marks and tags of the reply format.
DESIGN_HEADER = "data_title,data_type,data_description,data_example,data_regex"
EXCLUDE_MARK = "```EXCLUDE```"
UNIQUE_MARK = "```UNIQUE```"
FLAGGED_MARK = "```FLAGGED"
EXISTING_MARKS = ("… Existing Data …", "... Existing Data ...")
DESIGN_TAG = "schema_design"
CORRECTIONS_TAG = "semantic_diff"
TABLE_TAG = "user_data"


def section(text: Column | str, tag: str) -> Column:
    """Trimmed text of the first ``<tag>`` block; '' where there is none."""
    body = F.regexp_extract(as_col(text), rf"(?s)<{tag}>(.*?)</{tag}>", 1)
    return trim_space(F.coalesce(body, F.lit("")))


def _trimmed_lines(body: Column) -> Column:
    return F.transform(F.split(body, "\n"), trim_space)


def parse_contract(
    replies: DataFrame,
    header: Column | None = None,
    text: str = "text",
    keep: Sequence[str] = ("reply_id",),
) -> DataFrame:
    """Contract rows of each schema-design reply, bound to the original header by position.

    ``header`` is an array column with the original names; without it the first line of the
    reply's table block is used, less a leading ID. Originals without a design become
    ``UNMAPPED_<i>``; designs without an original get the key ``MISSING_ORIGINAL_<i>`` (both
    0-based). EXCLUDE and UNIQUE marks hold for every design of the same name.
    """
    if header is None:
        names = F.transform(csv_fields(F.split(section(text, TABLE_TAG), "\n")[0]), trim_space)
        header = F.when(
            F.get(names, F.lit(0)) == "ID", F.slice(names, 2, F.greatest(F.size(names), F.lit(1)))
        ).otherwise(names)

    def design(line: Column) -> Column:
        bare = F.replace(F.replace(line, F.lit(EXCLUDE_MARK)), F.lit(UNIQUE_MARK))
        pattern = F.regexp_extract(bare, r"(?s)^.*?,(\^.*)$", 1)
        fields = csv_fields(F.regexp_replace(bare, r"(?s),\^.*$", ""))

        def field(i: int) -> Column:
            return F.coalesce(trim_space(F.get(fields, F.lit(i))), F.lit(""))

        return F.struct(
            field(0).alias("name"),
            line.startswith(EXCLUDE_MARK).alias("excluded"),
            line.startswith(UNIQUE_MARK).alias("unique"),
            field(1).alias("data_type"),
            field(2).alias("description"),
            field(3).alias("example"),
            trim_space(pattern).alias("regex"),
        )

    lines = F.filter(
        _trimmed_lines(section(text, DESIGN_TAG)), lambda l: (l != "") & (l != DESIGN_HEADER)
    )
    parsed = replies.select(
        *keep, header.alias("_header"), F.transform(lines, design).alias("_designs")
    )
    bound = parsed.select(
        *keep,
        F.transform(F.filter("_designs", lambda d: d["excluded"]), lambda d: d["name"]).alias("_x"),
        F.transform(F.filter("_designs", lambda d: d["unique"]), lambda d: d["name"]).alias("_u"),
        F.posexplode(F.arrays_zip("_header", "_designs")).alias("_i", "_e"),
    )
    design_col, i = F.col("_e._designs"), F.col("_i")
    mapped = design_col.isNotNull()

    def part(name: str) -> Column:
        return F.coalesce(design_col[name], F.lit(""))

    return bound.select(
        *keep,
        F.coalesce(F.col("_e._header"), F.concat(F.lit("MISSING_ORIGINAL_"), i)).alias(
            "original_name"
        ),
        F.when(mapped, part("name")).otherwise(F.concat(F.lit("UNMAPPED_"), i)).alias("name"),
        F.when(mapped, F.array_contains("_x", part("name"))).otherwise(False).alias("is_excluded"),
        F.when(mapped, F.array_contains("_u", part("name"))).otherwise(False).alias("is_unique"),
        (i + 1).alias("index"),
        *[part(c).alias(c) for c in ("data_type", "description", "example", "regex")],
    )


def _correction_lines(replies: DataFrame, text: str, keep: Sequence[str]) -> DataFrame:
    """Trimmed non-blank lines of the correction block with their 1-based place."""
    body = F.posexplode(_trimmed_lines(section(text, CORRECTIONS_TAG))).alias("_seq", "_line")
    line = F.col("_line")
    existing = line.contains(EXISTING_MARKS[0]) | line.contains(EXISTING_MARKS[1])
    return (
        replies.select(*keep, body)
        .filter((line != "") & ~existing)
        .withColumn("seq", F.col("_seq").cast("long") + 1)
        .drop("_seq")
    )


def parse_row_patches(
    replies: DataFrame, text: str = "text", keep: Sequence[str] = ("reply_id",)
) -> DataFrame:
    """``row_id``, ``values``, ``flagged`` and ``seq`` of each corrected row.

    A FLAGGED prefix is taken off and the row kept; only lines that begin with a number and a
    comma count.
    """
    flagged = F.col("_line").startswith(FLAGGED_MARK)
    bare = trim_space(F.regexp_replace("_line", r"^```FLAGGED[^`]*```", ""))
    fields = F.col("_fields")
    return (
        _correction_lines(replies, text, keep)
        .select(
            *keep, "seq", flagged.alias("flagged"), F.when(flagged, bare).otherwise(F.col("_line")).alias("_line")
        )
        .filter(F.col("_line").rlike(r"^\d+,"))
        .select(*keep, "seq", "flagged", csv_fields(F.col("_line")).alias("_fields"))
        .select(
            *keep,
            fields[0].try_cast("long").alias("row_id"),
            F.slice(fields, 2, F.size(fields)).alias("values"),
            "flagged",
            "seq",
        )
        .filter(F.col("row_id").isNotNull())
    )


def parse_cell_patches(
    replies: DataFrame,
    text: str = "text",
    column: str = "column",
    source: str = "source",
    keep: Sequence[str] = (),
) -> DataFrame:
    """``row_id``, ``column``, ``corrected_value``, ``source`` and ``seq`` of each correction.

    A line is split at its first comma only and one outer pair of quotes is taken off; FLAGGED
    lines are not corrections and drop out.
    """
    return (
        _correction_lines(replies, text, [column, source, *keep])
        .filter(F.col("_line").rlike(r"^\d+,"))
        .select(
            *keep,
            F.regexp_extract("_line", r"^(\d+),", 1).try_cast("long").alias("row_id"),
            as_col(column).alias("column"),
            unquote(F.regexp_extract("_line", r"(?s)^\d+,(.*)$", 1)).alias("corrected_value"),
            as_col(source).alias("source"),
            "seq",
        )
        .filter(F.col("row_id").isNotNull())
    )


def scope_row_patches(
    replies: DataFrame,
    index: Column | int,
    text: str = "text",
    keep: Sequence[str] = ("reply_id",),
) -> DataFrame:
    """(id text, value) example pairs for the column at 1-based ``index`` of the row patches."""
    place = F.lit(index) if isinstance(index, int) else index
    extra = [] if isinstance(index, int) else [place.alias("_index")]
    fields = F.col("_fields")
    wanted = place if isinstance(index, int) else F.col("_index")
    return (
        _correction_lines(replies.select("*", *extra), text, [*keep, *(["_index"] if extra else [])])
        .filter(~F.col("_line").startswith(FLAGGED_MARK))
        .select("*", csv_fields(F.col("_line")).alias("_fields"))
        .filter(F.size(fields) > wanted)
        .select(*keep, "seq", fields[0].alias("id"), F.get(fields, wanted).alias("value"))
    )


def scope_contract(
    contract: DataFrame, columns: DataFrame, keep: Sequence[str] = ()
) -> DataFrame:
    """Schema text of each wanted ``column``: its own line under the header line.

    A column the contract does not know gets the whole text. ``keep`` columns identify the
    contract where there are several; a contract has one row per table column.
    """
    line = F.concat_ws(
        ",", "name", "data_type", "description", "example", "regex"
    )
    lines = contract.select(*keep, F.col("name").alias("column"), "index", line.alias("_line"))
    listed = F.transform(
        F.sort_array(F.collect_list(F.struct("index", "_line"))), lambda e: e["_line"]
    )
    whole = lines.groupBy(*keep).agg(F.array_join(listed, "\n").alias("_whole"))
    own = lines.groupBy(*keep, "column").agg(F.min_by("_line", "index").alias("_own"))
    scoped = columns.join(own, [*keep, "column"], "left").withColumn("_alone", F.col("_own").isNull())
    # Only columns that the contract lacks get its whole text.
    whole = whole.withColumn("_alone", F.lit(True))
    scoped = scoped.join(whole, [*keep, "_alone"], "left")
    return scoped.select(
        *keep,
        "column",
        F.concat(
            F.lit(DESIGN_HEADER + "\n"), F.coalesce("_own", "_whole", F.lit(""))
        ).alias("schema_text"),
        F.col("_own").isNotNull().alias("found"),
    )


def parse_decisions(
    replies: DataFrame, text: str = "text", keep: Sequence[str] = ("reply_id",)
) -> DataFrame:
    """``leader_id`` and ``keep_id`` of each group block that names a row to keep."""
    blocks = F.regexp_extract_all(
        as_col(text), F.lit(r"(?s)(<group_(\d+)>.*?</group_\2>)"), F.lit(1)
    )
    block = F.col("_block")
    body = trim_space(F.regexp_extract(block, r"(?s)^<group_\d+>(.*)</group_\d+>$", 1))
    return (
        replies.select(*keep, F.explode(blocks).alias("_block"))
        .select(
            *keep,
            F.regexp_extract(block, r"^<group_(\d+)>", 1).try_cast("long").alias("leader_id"),
            F.regexp_extract(body, r"^(\d+),", 1).try_cast("long").alias("keep_id"),
        )
        .filter(F.col("leader_id").isNotNull() & F.col("keep_id").isNotNull())
    )


def parse_removal_list(
    replies: DataFrame, text: str = "text", keep: Sequence[str] = ("reply_id",)
) -> DataFrame:
    """Row ids of the first bare JSON array of numbers in each reply."""
    listed = F.from_json(F.regexp_extract(as_col(text), r"(\[[\d\s,]+\])", 1), "array<bigint>")
    return (
        replies.select(*keep, F.explode(listed).alias("row_id")).filter("row_id >= 1").distinct()
    )
