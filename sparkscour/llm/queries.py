"""The registered queries of this subpackage, each over its whole tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.llm import divergence, edit_fingerprints, hard_negatives, jaccard_tiles, license_index, line_spread, pivotal, secret_index, string_kernel, surrogates, token_alignment, trie_bpe, warc
from sparkscour.session import checkpoint_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql is not None:
            ORACLES[name] = sql
        return build

    return add


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query("op1_secret_index", secret_index.report_sql())
def op1_secret_index(spark: SparkSession, folder: str) -> DataFrame:
    return secret_index.report(documents(spark, folder))


@query("op2_divergence")
def op2_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return divergence.judge(documents(spark, folder))


@query(
    "op3_line_spread",
    r"""
    WITH l AS (
      SELECT doc_id, source, unnest(generate_series(1, len(p))) AS i, unnest(p) AS raw
      FROM (SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
    ), t AS (
      SELECT doc_id, source, i, raw, trim(raw, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS line FROM l
    ), s AS (
      SELECT line, min((doc_id, i)) AS first FROM t WHERE line <> ''
      GROUP BY line HAVING count(DISTINCT source) >= 10
    ), k AS (
      SELECT doc_id, i, raw, s.line IS NOT NULL AND first <> (doc_id, i) AS gone
      FROM t LEFT JOIN s ON t.line = s.line
    )
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_removed,
           sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS clean_sha256
    FROM k GROUP BY doc_id
    """,
)
def op3_line_spread(spark: SparkSession, folder: str) -> DataFrame:
    return line_spread.report(documents(spark, folder))


@query("op4_jaccard_tiles")
def op4_jaccard_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return jaccard_tiles.link(documents(spark, folder))


@query("op5_string_kernel")
def op5_string_kernel(spark: SparkSession, folder: str) -> DataFrame:
    docs = documents(spark, folder).select("doc_id", "text", "lang")
    model = string_kernel.fit(docs, ~string_kernel.held_out(F.col("doc_id")))
    found = string_kernel.predict(docs.select("doc_id", "text"), model)
    doc = F.col("row").getField("doc_id")
    return found.select(doc.alias("doc_id"), string_kernel.held_out(doc).alias("held_out"), "lang_pred", "score")


@query("op6_surrogates")
def op6_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    # The key of a run comes from the session's settings; this one serves where none is set.
    key = surrogates.Key(spark.conf.get("spark.sparkscour.surrogates.key", "a key for trial runs"))
    return surrogates.report(documents(spark, folder).select("doc_id", "text"), key)


@query("op7_edit_fingerprints")
def op7_edit_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return edit_fingerprints.fingerprints_with_classes(documents(spark, folder)).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.lower(F.hex("print")).alias("fingerprint"),
        F.lower(F.hex("edited_print")).alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        "shared_bands",
        "class_id",
    )


@query(
    "op8_warc",
    """
    WITH p AS (
      SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages
    ), o AS (SELECT d, n, max(page_id) AS owner FROM p WHERE n >= 1000 GROUP BY d, n)
    SELECT page_id, n AS payload_bytes, d AS payload_digest,
           CASE WHEN owner IS NULL OR owner IS NOT DISTINCT FROM page_id THEN 'response'
                ELSE 'revisit' END AS record_type,
           CASE WHEN owner IS DISTINCT FROM page_id THEN owner END AS refers_to,
           TRUE AS whole, CAST(NULL AS VARCHAR) AS fault
    FROM p LEFT JOIN o USING (d, n)
    """,
)
def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    archives = f"{checkpoint_folder(spark)}/warc-{uuid.uuid4().hex}"
    return warc.round_trip(pages, archives).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "whole", "fault"
    )


@query("op9_pivotal_mix")
def op9_pivotal_mix(spark: SparkSession, folder: str) -> DataFrame:
    report = pivotal.mix_report(documents(spark, folder))
    return report.select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


@query("op10_bpe")
def op10_bpe(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return trie_bpe.encode(documents(spark, folder), public_tokenizers.path("byte_bpe_50k.json"))


@query("op12_hard_negatives", hard_negatives.REPORT_SQL)
def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    return hard_negatives.mine(spark.read.parquet(f"{folder}/embeddings.parquet"))


@query("op13_license_index", license_index.scan_sql())
def op13_license_index(spark: SparkSession, folder: str) -> DataFrame:
    return license_index.scan(documents(spark, folder))


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers as vocabularies

    a, b = vocabularies.path("byte_bpe_50k.json"), vocabularies.path("piece_bpe_32k.model")
    return token_alignment.align(documents(spark, folder), a, b)
