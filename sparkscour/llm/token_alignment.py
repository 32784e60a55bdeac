"""Two tokenizers aligned over a corpus: which tokens end together, and how often each pair does.

Texts are encoded once. Links (a token of A and one of B that end at one byte) leave a task as sorted
runs, compressed and cut by the low bits of the B id. A run has a head (each pair with the number of its
documents and links) and a body (documents and links of each pair). Heads are merged by a heap, a bounded
number at a time, until one is left of each radix part: pairs stand there by B id, so the highest count of a
B id is known where its pairs end. Then runs meet the counts of their part, and what each document gets
goes back as one compressed row per run.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from collections.abc import Iterator, Sequence
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscour.llm.common import name, text_of
from sparkscour.llm.trie_bpe import byte_characters
from sparkscour.session import durable

# Parts by the low bits of the B id, and runs that one task merges on average.
RADIX = 16
FAN_IN = 64
# A run is written at so many links, or documents.
RUN_LINKS = 1 << 21
RUN_DOCUMENTS = 20_000
# Characters of text that are looked up at once, and bytes that a worker's cache may take.
CHUNK_CHARACTERS = 1 << 20
CACHE_BYTES = 64 << 20
# Spaces at which a text can't be cut: beside another, at an end, or between white characters.
UNCUT = re.compile(r" (?=[ ]|\Z)|\A | (?<=\s )(?=\s)")
SPACE = "▁"

EMPTY = ("", 0, b"")


def packed(*columns: np.ndarray) -> bytes:
    """Columns of equal length, each as its bytes by significance, compressed."""
    whole = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(whole)


def unpacked(blob: bytes, n_columns: int) -> list[np.ndarray]:
    whole = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    parts = whole.reshape(n_columns, 4, -1) if len(whole) else np.zeros((n_columns, 4, 0), np.uint8)
    return [np.ascontiguousarray(p.T).view("<u4").reshape(-1).astype(np.int64) for p in parts]


class Aligner:
    """Encodes texts by both tokenizers and cuts them into groups of tokens that end together."""

    def __init__(self, a_spec: str, b_model: bytes):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(a_spec)
        self.a.encode_special_tokens = True
        self.a.no_truncation()
        self.a.no_padding()
        self.b = sentencepiece.SentencePieceProcessor(model_proto=b_model)
        to_byte = byte_characters()
        vocabulary = self.a.get_vocab(with_added_tokens=True)
        added = {t.content for t in self.a.get_added_tokens_decoder().values()}
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.a_bytes[i] = token.encode() if token in added else bytes(to_byte[c] for c in token)
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.b_bytes = [
            bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)
        ]
        if max(len(self.a_bytes), len(self.b_bytes)) > 1 << 16:
            raise ValueError("vocabularies of at most 65,536 tokens can be aligned")
        # Where no piece goes on past a space, words are encoded each by itself.
        self.by_words = not any(SPACE in p[1:] and p.strip(SPACE) for p in pieces)
        self.a_sizes = np.array([len(t) for t in self.a_bytes], dtype=np.int64)
        self.b_sizes = np.array([len(t) for t in self.b_bytes], dtype=np.int64)
        # Decimal ids with what follows them: inside a group, and at the end of its side.
        self.a_text = [f"{i}{sign}" for i in range(len(self.a_bytes)) for sign in ",|"]
        self.b_text = [f"{i}{sign}" for i in range(len(self.b_bytes)) for sign in ",;"]
        self.known: dict[str, tuple | None] = {}
        self.held = 0

    def aligned(self, texts: Sequence[str]) -> list[tuple | None]:
        """Per text its groups, the numbers of A and B tokens in one integer, and its links as bytes.

        None where the bytes of the tokens aren't the text's with a space before it.
        """
        a_ids = [e.ids for e in self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)]
        b_ids = self.b.encode(list(texts), num_threads=1)
        out: list[tuple | None] = [None] * len(texts)
        good = []
        for k, text in enumerate(texts):
            want = b" " + text.encode()
            if text and b"".join(map(self.a_bytes.__getitem__, a_ids[k])) == want == b"".join(map(self.b_bytes.__getitem__, b_ids[k])):
                good.append(k)
        if not good:
            return out
        # The good texts one after the other: offsets in them, and so common ends, go on.
        a = np.array([i for k in good for i in a_ids[k]], dtype=np.int64)
        b = np.array([i for k in good for i in b_ids[k]], dtype=np.int64)
        _, a_ends, b_ends = np.intersect1d(np.cumsum(self.a_sizes[a]), np.cumsum(self.b_sizes[b]), assume_unique=True, return_indices=True)
        links = (b[b_ends] << 16 | a[a_ends]).astype("<u4")
        a_last, b_last = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
        a_last[a_ends], b_last[b_ends] = 1, 1
        side = np.r_[2 * (np.cumsum(a_last) - a_last), 2 * (np.cumsum(b_last) - b_last) + 1]
        order = np.argsort(side, kind="stable")
        marks = [*map(self.a_text.__getitem__, (2 * a + a_last).tolist()), *map(self.b_text.__getitem__, (2 * b + b_last).tolist())]
        marks = [marks[i] for i in order.tolist()]
        n_a, n_b = [len(a_ids[k]) for k in good], [len(b_ids[k]) for k in good]
        token_ends = list(accumulate(x + y for x, y in zip(n_a, n_b)))
        link_ends = np.searchsorted(a_ends, np.cumsum(n_a)).tolist()
        raw, t, x = links.tobytes(), 0, 0
        for k, na, nb, t_end, x_end in zip(good, n_a, n_b, token_ends, link_ends):
            out[k] = "".join(marks[t:t_end])[:-1], na << 32 | nb, raw[4 * x : 4 * x_end]
            t, x = t_end, x_end
        return out

    def texts(self, texts: Sequence[str]) -> Iterator[tuple]:
        """Like ``aligned``, in order, with words that were seen before looked up."""
        chunk: list[str] = []
        size = 0
        for text in texts:
            chunk.append(text)
            size += len(text)
            if size >= CHUNK_CHARACTERS:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, texts: list[str]) -> Iterator[tuple]:
        if self.held > CACHE_BYTES:
            self.known.clear()
            self.held = 0
        cut = [t.split(" ") if self.by_words and t and not UNCUT.search(t) else None for t in texts]
        new = list({p for pieces in cut if pieces for p in pieces}.difference(self.known))
        for found, piece in zip(self.aligned(new) if new else [], new):
            self.known[piece] = found
            self.held += 400 + 4 * len(piece) + (2 * len(found[0]) if found else 0)
        known = self.known
        for text, pieces in zip(texts, cut):
            parts = [known[p] for p in pieces] if pieces else [None]
            if None in parts:
                # Cut texts too: tokens of some word give other bytes, so the whole text decides.
                yield (self.aligned([text])[0] if text else None) or EMPTY
            else:
                yield ";".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts])


_ALIGNERS: dict[bytes, Aligner] = {}


def aligner_for(a_spec: str, b_model: bytes) -> Aligner:
    """One per worker process, as loading vocabularies takes longer than a small task."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    key = hashlib.sha256(a_spec.encode() + b_model).digest()
    if key not in _ALIGNERS:
        _ALIGNERS.clear()
        _ALIGNERS[key] = Aligner(a_spec, b_model)
    return _ALIGNERS[key]


SPILLED = (
    "part int, seq int, radix int, place int, doc_id long, n_a long, n_b long, n_links long, "
    "groups_sha256 string, heads binary, body binary"
)


class Spill:
    """Rows of documents and the runs of their links, written together when enough have come."""

    def __init__(self, part: int, radix: int):
        self.part, self.radix, self.seq = part, radix, 0
        self.rows: list[tuple] = []
        self.links: list[bytes] = []
        self.sizes: list[int] = []
        self.n = 0

    def add(self, doc_id: int | None, groups: str, tokens: int, links: bytes) -> bool:
        digest = hashlib.sha256(groups.encode()).hexdigest() if groups else ""
        self.rows.append((doc_id, tokens >> 32, tokens & 0xFFFFFFFF, len(links) // 4, digest))
        self.links.append(links)
        self.sizes.append(len(links) // 4)
        self.n += len(links) // 4
        return self.n >= RUN_LINKS or len(self.rows) >= RUN_DOCUMENTS

    def runs(self) -> Iterator[tuple[int, bytes, bytes]]:
        pair = np.frombuffer(b"".join(self.links), "<u4").astype(np.int64)
        keys, links = np.unique(pair << 32 | np.repeat(np.arange(len(self.sizes)), self.sizes), return_counts=True)
        of = (keys >> 48) % self.radix
        for r in np.unique(of):
            mine, n = keys[of == r], links[of == r]
            pair = mine >> 32
            first = np.flatnonzero(np.r_[True, pair[1:] != pair[:-1]])
            heads = packed(pair[first], np.diff(np.r_[first, len(pair)]), np.add.reduceat(n, first))
            yield int(r), heads, packed(mine & 0xFFFFFFFF, n)

    def flush(self) -> pa.RecordBatch | None:
        if not self.rows:
            return None
        runs, docs, n = list(self.runs()), len(self.rows), len(self.rows)
        n += len(runs)
        none = [None] * docs
        columns = [
            pa.array([self.part] * n, pa.int32()),
            pa.array([self.seq] * n, pa.int32()),
            pa.array(none + [r[0] for r in runs], pa.int32()),
            pa.array([*range(docs), *[None] * len(runs)], pa.int32()),
            *[pa.array([*[r[k] for r in self.rows], *[None] * len(runs)], pa.int64()) for k in range(4)],
            pa.array([*[r[4] for r in self.rows], *[None] * len(runs)], pa.string()),
            pa.array(none + [r[1] for r in runs], pa.binary()),
            pa.array(none + [r[2] for r in runs], pa.binary()),
        ]
        self.rows, self.links, self.sizes, self.n = [], [], [], 0
        self.seq += 1
        return pa.RecordBatch.from_arrays(columns, [c.split(" ")[0] for c in SPILLED.split(", ")])


def spilled(docs: DataFrame, a_path: str, b_path: str, radix: int, text: str) -> DataFrame:
    """A row per document, and a row per run and radix part of the links."""
    with open(a_path, encoding="utf-8") as a, open(b_path, "rb") as b:
        files = docs.sparkSession.sparkContext.broadcast((a.read(), b.read()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = aligner_for(*files.value)
        spill = Spill(TaskContext.get().partitionId(), radix)
        for batch in batches:
            found = aligner.texts(x.as_py() for x in batch.column(1))
            for doc_id, one in zip(batch.column(0).to_pylist(), found):
                if spill.add(doc_id, *one):
                    yield spill.flush()
        if (last := spill.flush()) is not None:
            yield last

    chosen = docs.select(name("doc_id").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return durable(chosen.mapInArrow(run, SPILLED))


def merged(heads: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and links of many heads, by a heap of the heads' next pairs."""

    def stream(blob: bytes) -> Iterator[tuple[int, int]]:
        pairs, _, links = unpacked(blob, 3)
        return zip(pairs.tolist(), links.tolist())

    pairs, links, last = [], [], -1
    for pair, n in heapq.merge(*map(stream, heads)):
        if pair == last:
            links[-1] += n
        else:
            pairs.append(pair)
            links.append(n)
            last = pair
    return np.array(pairs, np.int64), np.array(links, np.int64)


def _wide(pairs: np.ndarray, links: np.ndarray) -> bytes:
    # Links of a corpus may need more than 32 bits: a high and a low half.
    return packed(pairs, links >> 32, links & 0xFFFFFFFF)


def pair_counts(runs: DataFrame, fan_in: int = FAN_IN) -> DataFrame:
    """``radix``, ``counts``: pairs, their links in two halves, and whether no pair of the B id has more."""

    def count(key: tuple, table: pa.Table) -> pa.Table:
        pairs, links = merged(table["heads"].to_pylist())
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_wide(pairs, links)], pa.binary())})

    def sum_up(key: tuple, table: pa.Table) -> pa.Table:
        def stream(blob: bytes) -> Iterator[tuple[int, int]]:
            pairs, high, low = unpacked(blob, 3)
            return zip(pairs.tolist(), (high << 32 | low).tolist())

        totals: dict[int, int] = {}
        for pair, n in heapq.merge(*map(stream, table["counts"].to_pylist())):
            totals[pair] = totals.get(pair, 0) + n
        pairs, links = np.fromiter(totals, np.int64, len(totals)), np.fromiter(totals.values(), np.int64, len(totals))
        return pa.table({"radix": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([_wide(pairs, links)], pa.binary())})

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            blobs = []
            for blob in batch.column(1).to_pylist():
                pairs, high, low = unpacked(blob, 3)
                links, side = high << 32 | low, pairs >> 16
                # Pairs of one B id stand together, so its highest count is that of a stretch.
                first = np.flatnonzero(np.r_[True, side[1:] != side[:-1]])
                most = np.repeat(np.maximum.reduceat(links, first), np.diff(np.r_[first, len(side)]))
                blobs.append(packed(pairs, high, low, links == most))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(blobs, pa.binary())], ["radix", "counts"])

    schema = "radix int, counts binary"
    most = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-most // fan_in))
    group = F.pmod(F.xxhash64("part", "seq"), F.lit(groups)).alias("g")
    held = durable(runs.select("radix", group, "heads").groupBy("radix", "g").applyInArrow(count, schema))
    while groups > 1:
        groups = -(-groups // fan_in)
        spread = F.pmod(F.xxhash64("counts"), F.lit(groups)).alias("g")
        held = durable(held.select("radix", spread, "counts").groupBy("radix", "g").applyInArrow(sum_up, schema))
    return held.mapInArrow(best, schema)


def _shares(key: tuple, runs: pa.Table, counts: pa.Table) -> pa.Table:
    """What the documents of each run get from the pairs of one radix part."""
    rows = []
    if runs.num_rows:
        pairs, high, low, best = unpacked(counts["counts"][0].as_py(), 4)
        links = high << 32 | low
        for part, seq, heads, body in zip(*(runs[c].to_pylist() for c in ("part", "seq", "heads", "body"))):
            own, documents, _ = unpacked(heads, 3)
            places, n = unpacked(body, 2)
            at = np.repeat(np.searchsorted(pairs, own), documents)
            size = int(places.max()) + 1
            total, tops = np.zeros(size, np.int64), np.zeros(size, np.int64)
            np.add.at(total, places, links[at] * n)
            np.add.at(tops, places, best[at] * n)
            rows.append((part, seq, packed(total >> 32, total & 0xFFFFFFFF, tops)))
    return pa.table(
        {
            "part": pa.array([r[0] for r in rows], pa.int32()),
            "seq": pa.array([r[1] for r in rows], pa.int32()),
            "share": pa.array([r[2] for r in rows], pa.binary()),
        }
    )


def _documents(key: tuple, docs: pa.Table, shares: pa.Table) -> pa.Table:
    """The documents of one run with the sums of what its parts gave back."""
    places = docs["place"].to_numpy()
    size = int(places.max(initial=-1)) + 1
    total, tops = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for blob in shares["share"].to_pylist():
        high, low, n = unpacked(blob, 3)
        total[: len(n)] += high << 32 | low
        tops[: len(n)] += n
    kept = docs.select(["doc_id", "n_a", "n_b", "n_links", "groups_sha256"])
    return pa.table(
        {
            "doc_id": kept["doc_id"],
            "n_a": kept["n_a"],
            "n_b": kept["n_b"],
            "n_groups": kept["n_links"],
            "n_links": kept["n_links"],
            "n_best": tops[places],
            "count_sum": total[places],
            "groups_sha256": kept["groups_sha256"],
        }
    )


def align(docs: DataFrame, a_path: str, b_path: str, radix: int = RADIX, fan_in: int = FAN_IN, text: str = "text") -> DataFrame:
    """Per document: tokens, groups, links, links that are the best of their B id, and the sum of counts.

    ``a_path`` is a byte-level file of the tokenizers library, ``b_path`` a sentencepiece model; the driver
    reads both and they go to the executors, so their sizes bound the broadcast. Each group ends where a
    token of each side ends, so it has one link.

    Null and empty texts, and texts that a tokenizer changes, have no tokens and zeros. Strings of special
    tokens are plain text. Documents are known by their place in a task, so null and repeated ids count as
    documents of their own; other columns are dropped; an empty table gives an empty one. A text with spaces
    side by side, at an end or between white characters is encoded whole instead of by words.
    """
    rows = spilled(docs, a_path, b_path, radix, text)
    runs = rows.filter(F.col("radix").isNotNull())
    counts = pair_counts(runs, fan_in)
    # Runs of one part are dealt to tasks; each task gets the counts of its part.
    most = runs.groupBy("radix").count().agg(F.max("count")).first()[0] or 0
    groups = max(1, -(-most // fan_in))
    dealt = runs.select("part", "seq", "heads", "body", "radix", F.pmod(F.xxhash64("part", "seq"), F.lit(groups)).cast("int").alias("g"))
    copies = counts.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    shares = dealt.groupBy("radix", "g").cogroup(copies.groupBy("radix", "g")).applyInArrow(
        _shares, "part int, seq int, share binary"
    )
    listed = rows.filter(F.col("radix").isNull())
    return listed.groupBy("part", "seq").cogroup(shares.groupBy("part", "seq")).applyInArrow(
        _documents,
        "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string",
    )
