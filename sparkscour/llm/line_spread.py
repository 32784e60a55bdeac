"""Removal of boilerplate lines, found by how many sites a line is spread over."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import let, name, packed, text_of
from sparkscour.session import durable

MIN_SITES = 10
# 2 ** LG_K registers per sketch; a sketch of few sites stays a short list.
LG_K = 10
# Standard errors around the threshold within which sites are counted exactly.
MARGIN = 4.0
TRIMMED = " \t\r\x0b\x0c"
LINE = ["_h1", "_h2"]
DOC = ["_nodoc", "_doc", "_text_hash"]


def _keys(docs: DataFrame) -> list[Column]:
    doc = name("doc_id").cast("long")
    return [
        doc.isNull().alias("_nodoc"),
        F.coalesce(doc, F.lit(0)).alias("_doc"),
        F.xxhash64(text_of(docs)).alias("_text_hash"),
    ]


def line_rows(docs: DataFrame, site: str = "source") -> DataFrame:
    """A row per line that isn't blank: its document, place, 128-bit hash without outer blanks, and site."""
    lines = F.split(text_of(docs), "\n", -1)
    rows = docs.select(
        *_keys(docs), name(site).cast("string").alias("_site"), F.posexplode(lines).alias("_at", "_line")
    )
    trimmed = F.btrim("_line", F.lit(TRIMMED))
    return rows.filter(trimmed != "").select(
        *DOC, "_site", "_at", F.xxhash64(trimmed).alias("_h1"), F.xxhash64(F.lit(1), trimmed).alias("_h2")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Lines on at least ``min_sites`` sites: their hash and first occurrence (``_first``).

    Sketches are built before the shuffle and merged by line. An estimate farther than ``MARGIN``
    standard errors from the threshold decides; lines nearer to it are counted exactly.
    """
    error = MARGIN * 1.04 / (1 << LG_K) ** 0.5
    sketched = lines.groupBy(*LINE).agg(
        F.hll_sketch_agg("_site", LG_K).alias("_sketch"),
        F.min(F.struct("_nodoc", "_doc", "_text_hash", "_at")).alias("_first"),
    )
    estimate = F.hll_sketch_estimate("_sketch")
    likely = durable(
        sketched.select(*LINE, "_first", estimate.alias("_sites")).filter(
            F.col("_sites") >= F.lit(int(min_sites * (1 - error)))
        )
    )
    sure = F.col("_sites") > F.lit(min_sites * (1 + error) + 1)
    near = likely.filter(~sure)
    # Distinct pairs are made before the shuffle, so a line on every page comes as few rows.
    pairs = lines.select(*LINE, "_site").distinct().join(near.select(*LINE), LINE, "left_semi")
    counted = pairs.groupBy(*LINE).agg(F.count("_site").alias("_exact"))
    exact = near.join(counted.filter(F.col("_exact") >= min_sites), LINE, "left_semi")
    return likely.filter(sure).select(*LINE, "_first").unionByName(exact.select(*LINE, "_first"))


def cleaned(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source") -> DataFrame:
    """The rows (``row``) with their text after removal (``clean``), ``n_lines`` and ``n_removed``.

    A line on at least ``min_sites`` distinct values of ``site`` is boilerplate and goes from every
    document, but for its first occurrence (smallest ``doc_id``, null last, then first line), so
    that no content is lost from the corpus. Lines compare without blanks at their ends; blank lines
    are never removed. Rows without a site count for none. Rows equal in id and text are treated
    alike: a first occurrence stays in all of them. A null text stays null, an empty one empty; an
    empty table gives an empty one.
    """
    lines = line_rows(docs, site)
    spread = durable(spread_lines(lines, min_sites))
    again = ~(F.struct(*DOC, "_at") == F.col("_first"))
    # Copies of a row give the same places several times, so places are a set.
    removed = lines.join(spread, LINE).filter(again).groupBy(*DOC).agg(F.collect_set("_at").alias("_gone"))
    rows = docs.select(*_keys(docs), text_of(docs).alias("_text"), name("text").isNull().alias("_none"), packed(docs).alias("row"))
    joined = rows.join(removed, DOC, "left")

    def rest(parts: Column) -> Column:
        kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_gone"))
        return F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")

    text = F.when(F.col("_none"), F.lit(None)).when(F.col("_gone").isNull(), F.col("_text"))
    return joined.select(
        "row",
        text.otherwise(let(F.split("_text", "\n", -1), rest)).alias("clean"),
        F.size(F.split("_text", "\n", -1)).cast("long").alias("n_lines"),
        F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"),
    )


def report(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """Per document: ``doc_id``, ``n_lines``, ``n_removed`` and ``clean_sha256`` of the text left (null: empty)."""
    return cleaned(docs, min_sites).select(
        F.col("row").getField("doc_id").cast("long").alias("doc_id"),
        "n_lines",
        F.greatest("n_removed", F.lit(0)).alias("n_removed"),
        F.sha2(F.coalesce("clean", F.lit("")).cast("binary"), 256).alias("clean_sha256"),
    )


def dedup_lines(docs: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """``docs`` with boilerplate lines removed; documents of which nothing is left go.

    ``n_chars``, if there, follows the text. Documents that had no text before stay.
    """
    done = cleaned(docs, min_sites)
    blank = F.btrim(F.coalesce("clean", F.lit("")), F.lit(TRIMMED + "\n")) == ""
    kept = done.filter((F.col("n_removed") <= 0) | ~blank)
    new = {"text": F.col("clean"), "n_chars": F.char_length("clean")}
    kinds = dict(docs.dtypes)
    return kept.select(
        *[
            (new[c].cast(kinds[c]) if c in new else F.col("row").getField(c)).alias(c)
            for c in docs.columns
        ]
    )
