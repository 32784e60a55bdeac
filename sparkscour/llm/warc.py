"""WARC archives: one gzip member per record, written by Spark and read back in sequence."""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscour.llm.common import name

SCHEMA = (
    "archive string, place long, record_id string, record_type string, target_uri string, "
    "refers_to string, payload_bytes long, payload_digest string, whole boolean, fault string"
)
# Bytes that are decompressed at a time.
BLOCK = 1 << 16
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {}\r\n\r\n"
SAME_PAYLOAD = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EMPTY_MEMBER = zlib.compressobj(9, zlib.DEFLATED, 31).flush()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def page_of(record: str | None) -> int | None:
    digits = (record or "").removeprefix("<urn:page:").removesuffix(">")
    return int(digits) if digits.lstrip("-").isdigit() else None


def plan_records(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Which pages are responses and which are revisits of an equal payload.

    Adds to ``page_id``, ``url`` and ``payload`` (the html in UTF-8; null is empty): ``bytes``,
    ``digest`` (SHA-1, hexadecimal), ``record_type`` and ``refers_to``. Of pages with equal payloads
    of at least ``least_bytes``, those with the largest ``page_id`` are responses (repeated rows all
    are), and rows without id are revisits; where no row has an id, all are responses.
    """
    payload = F.coalesce(name("html").cast("string"), F.lit("")).cast("binary")
    base = pages.select(
        name("page_id").cast("long").alias("page_id"),
        name("url").cast("string").alias("url"),
        payload.alias("payload"),
        F.length(payload).cast("long").alias("bytes"),
        F.sha1(payload).alias("digest"),
    )
    # One row per repeated payload: counted before the shuffle, so copies never meet in one task.
    owners = (
        base.filter(F.col("bytes") >= least_bytes)
        .groupBy("digest", "bytes")
        .agg(F.max("page_id").alias("owner"), F.count(F.lit(1)).alias("copies"))
        .filter((F.col("copies") > 1) & F.col("owner").isNotNull())
        .drop("copies")
    )
    again = F.col("owner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("owner"))
    return base.join(owners, ["digest", "bytes"], "left").select(
        "page_id",
        "url",
        "payload",
        "bytes",
        "digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"),
        F.when(again, F.col("owner")).alias("refers_to"),
    )


def base32(digest: bytes) -> str:
    return "sha1:" + base64.b32encode(digest).decode()


def member(
    page_id: int | None,
    url: str | None,
    payload: bytes,
    digest: str,
    size: int,
    kind: str,
    refers_to: int | None,
    date: str,
) -> bytes:
    """One record as a gzip member. A revisit carries the HTTP header without the payload."""
    block = HTTP_HEAD.format(size).encode() + (payload if kind == "response" else b"")
    fields = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(page_id),
        "WARC-Date": date,
        "WARC-Target-URI": (url or "").replace("\r", "%0D").replace("\n", "%0A"),
        "WARC-Payload-Digest": base32(bytes.fromhex(digest)),
        "WARC-Block-Digest": base32(hashlib.sha1(block).digest()),
        "WARC-Payload-Length": str(size),
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": str(len(block)),
    }
    if kind == "revisit":
        fields |= {"WARC-Refers-To": record_id(refers_to), "WARC-Profile": SAME_PAYLOAD}
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields.items()) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    out = packer.compress(head.encode()) + packer.compress(block)
    return out + packer.compress(b"\r\n\r\n") + packer.flush()


def write_archives(
    pages: DataFrame, folder: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z"
) -> None:
    """Write a record per row of ``pages`` (``page_id``, ``url``, ``html``) into ``folder``.

    Spark's text sink writes the archives, one per task, so that they can go to any store and a
    lost task is written again. It puts one separator byte after each row; a gzip member ends with
    the top byte of its length, which is 0 below 16 MiB, so that byte serves as the separator. A
    longer member is followed by an empty one, which holds no record.
    """

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page, url, payload, size, digest, kind, ref in frame.itertuples(index=False, name=None):
                page, ref = (None if pd.isna(x) else int(x) for x in (page, ref))
                data = member(page, url, payload, digest, int(size), kind, ref, date)
                out.append((data if data[-1] == 0 else data + EMPTY_MEMBER)[:-1])
            yield pd.DataFrame({"value": out})

    planned = plan_records(pages, least_bytes).select(
        "page_id", "url", "payload", "bytes", "digest", "record_type", "refers_to"
    )
    members = planned.mapInPandas(pack, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\u0000").text(folder)


class Damaged(Exception):
    pass


def _fields(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise Damaged("no WARC version line")
    pairs = (x.split(":", 1) for x in lines[1:] if ":" in x)
    return {k.strip().lower(): v.strip() for k, v in pairs}


def read_member(data: memoryview, start: int) -> tuple[int, dict | None]:
    """Read the gzip member at ``start``: where the next one starts, and its record.

    The member is decompressed a block at a time. The header is kept, then as many bytes as its
    content length says are hashed and let go, then the closing line ends follow.
    """
    unpack = zlib.decompressobj(31)
    at, head, fields = start, b"", None
    left, http, in_body = 0, b"", False
    block_hash, body_hash, body = hashlib.sha1(), hashlib.sha1(), 0
    tail = b""
    while not unpack.eof:
        if unpack.unconsumed_tail:
            got = unpack.decompress(unpack.unconsumed_tail, BLOCK)
        else:
            if at >= len(data):
                raise Damaged("the archive ends inside a record")
            piece = data[at : at + BLOCK]
            at += len(piece)
            got = unpack.decompress(piece, BLOCK)
        if fields is None:
            head += got
            cut = head.find(b"\r\n\r\n")
            if cut < 0:
                if len(head) > 1 << 20:
                    raise Damaged("the record's header does not end")
                continue
            fields = _fields(head[:cut])
            if not fields.get("content-length", "").isdigit():
                raise Damaged("no content length")
            left, got = int(fields["content-length"]), head[cut + 4 :]
            in_body = "application/http" not in fields.get("content-type", "")
        part, got = got[:left], got[left:]
        left -= len(part)
        block_hash.update(part)
        if not in_body:
            http += part
            cut = http.find(b"\r\n\r\n")
            if cut >= 0:
                in_body, part = True, http[cut + 4 :]
            else:
                part = b""
        body_hash.update(part)
        body += len(part)
        tail += got
        if len(tail) > 4:
            raise Damaged("more bytes than the content length says")
    after = at - len(unpack.unused_data)
    if fields is None:
        if head:
            raise Damaged("the record's header does not end")
        return after, None
    if left or tail != b"\r\n\r\n":
        raise Damaged("fewer bytes than the content length says")
    revisit = fields.get("warc-type") == "revisit"
    stated = fields.get("warc-payload-digest", "")
    whole = fields.get("warc-block-digest", base32(block_hash.digest())) == base32(block_hash.digest())
    if not revisit:
        whole &= stated in ("", base32(body_hash.digest()))
        digest, size = body_hash.hexdigest(), body
    else:
        digest = base64.b32decode(stated.removeprefix("sha1:")).hex() if stated.startswith("sha1:") else None
        length = fields.get("warc-payload-length", "")
        size = int(length) if length.isdigit() else None
    return after, {
        "record_id": fields.get("warc-record-id"),
        "record_type": fields.get("warc-type"),
        "target_uri": fields.get("warc-target-uri"),
        "refers_to": fields.get("warc-refers-to"),
        "payload_bytes": size,
        "payload_digest": digest,
        "whole": whole,
        "fault": None if whole else "digest differs",
    }


def read_records(content: bytes, archive: str = "") -> Iterator[dict]:
    """All records of one archive, in order.

    A damaged record gives a row with its ``fault`` and without fields; reading goes on at the next
    place where a gzip member starts.
    """
    data, at = memoryview(content), 0
    while at < len(data):
        try:
            after, record = read_member(data, at)
        except (Damaged, zlib.error, ValueError) as error:
            record = {"whole": False, "fault": str(error)}
            after = content.find(b"\x1f\x8b\x08", at + 1)
            after = len(data) if after < 0 else after
        if record is not None:
            yield {"archive": archive, "place": at, **record}
        at = after


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    """A row per record of the archives in ``folder``; see ``SCHEMA``.

    ``payload_bytes`` and ``payload_digest`` (bare hexadecimal) are of the full payload: measured for
    responses, as stated for revisits. ``whole`` tells whether the digests hold. An archive is read
    by one task and is in memory as compressed bytes; its records are decompressed a block at a time.
    """
    columns = [c.split()[0] for c in SCHEMA.split(", ")]

    def unpack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, content in frame.itertuples(index=False, name=None):
                rows = []
                for record in read_records(content, path):
                    rows.append([record.get(c) for c in columns])
                    if len(rows) == 1000:
                        yield typed(rows)
                        rows = []
                if rows:
                    yield typed(rows)

    def typed(rows: list[list]) -> pd.DataFrame:
        frame = pd.DataFrame(rows, columns=columns, dtype=object)
        return frame.astype({"place": "int64", "payload_bytes": "Int64", "whole": "bool"})

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder)
    return files.select("path", "content").mapInPandas(unpack, SCHEMA)


def round_trip(pages: DataFrame, folder: str, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` as archives into the new ``folder`` and read them back: one row per page.

    Null html is an empty payload, a null url an empty address, a null id stays null; repeated rows
    give repeated records. An empty table gives archives without records, so no rows. Long pages
    take several blocks. Other columns are not written.
    """
    write_archives(pages, folder, least_bytes)

    @F.pandas_udf("long")
    def page(ids: pd.Series) -> pd.Series:
        return pd.Series([page_of(x) for x in ids], dtype="Int64")

    return read_archives(pages.sparkSession, folder).select(
        page("record_id").alias("page_id"),
        "payload_bytes",
        "payload_digest",
        "record_type",
        page("refers_to").alias("refers_to"),
        "target_uri",
        "whole",
        "fault",
    )
