"""Byte-level BPE by a depth-first walk over the trie of distinct words.

For BPE the last token of a prefix's encoding is a state: the encoding of the prefix is the
encoding of what comes before that token, followed by the token. The state of a trie node thus
follows from the states of its ancestors, and words that share a prefix share its states. Distinct
words in sorted order are the leaves of their trie in depth-first order, so the walk needs only a
stack of the states on the current path.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
from collections.abc import Iterable, Iterator, Sequence
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from sparkscour.llm.common import name, text_of

# The split into words of byte-level BPE: a fixed pattern that must equal the tokenizer's.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# Distinct words whose encodings a worker keeps, and words held at once of one text.
CACHED_WORDS = 200_000
CACHED_PIECES = 300_000
# Pairs of tokens of which a worker remembers whether they stay apart.
CACHED_PAIRS = 300_000
# Steps from a node of the tokens' trie by a byte that a worker remembers.
CACHED_MOVES = 300_000
CHUNK_WORDS = 1 << 18
# Texts of a batch whose ids are held at once.
ROWS_AT_ONCE = 256
LONG_TEXT = 1 << 20
# A space between two white characters, or after one at the end of the text.
ODD_SPACE = re.compile(r" (?<=\s )(?:\s|\Z)")


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


def little_endian(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level BPE file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, to_byte = spec["model"], byte_characters()
        if model["type"] != "BPE" or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE file is needed")

        def raw(token: str) -> bytes:
            return bytes(to_byte[c] for c in token)

        ids = {t: i for t, i in model["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.bytes_of = {i: raw(t) for t, i in ids.items() if t not in self.special}
        self.bytes_of |= {i: t.encode() for t, i in self.special.items()}
        self.rank: dict[tuple[int, int], int] = {}
        # When a token comes into being, and the two tokens it is merged from.
        self.born = {i: -1 for i in self.bytes_of}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        for place, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            made = ids[a + b]
            self.rank[ids[a], ids[b]] = place
            if made not in self.left:
                self.born[made], self.left[made], self.right[made] = place, ids[a], ids[b]
        # Tokens as a trie of their bytes: (node * 256 + byte) -> node.
        self.edges: dict[int, int] = {}
        spelled, depths = [-1], [0]
        node_of: dict[int, int] = {}
        for i, token in self.bytes_of.items():
            if i in self.left or len(token) == 1:
                if i in self.left and not self.fits(self.left[i], self.right[i], self.born[i]):
                    continue  # its parts merge with each other in another way first
                node = 0
                for b in token:
                    key = node << 8 | b
                    if key not in self.edges:
                        self.edges[key] = len(spelled)
                        spelled.append(-1)
                        depths.append(depths[node] + 1)
                    node = self.edges[key]
                spelled[node] = i
                node_of[i] = node
        # The node of the longest shorter end of a node's bytes, the longest token that ends a node's
        # bytes, and the longest shorter one that ends a token's.
        self.back = [0] * len(spelled)
        self.ending = spelled
        for key in sorted(self.edges, key=lambda k: depths[k >> 8]):
            if key >> 8:
                self.back[self.edges[key]] = self.step(self.back[key >> 8], key & 255)
        for node in sorted(range(1, len(spelled)), key=depths.__getitem__):
            if spelled[node] < 0:
                spelled[node] = spelled[self.back[node]]
        self.shorter = {i: spelled[self.back[node]] for i, node in node_of.items()}
        self.moves: dict[int, int] = {}
        self.size = {i: len(t) for i, t in self.bytes_of.items()}
        self.pairs: dict[int, bool] = {}

    def step(self, node: int, byte: int) -> int:
        """The node of the longest end of a node's bytes and one more that the trie has."""
        while (found := self.edges.get(node << 8 | byte)) is None and node:
            node = self.back[node]
        return found or 0

    def fits(self, u: int, t: int, before: int = 1 << 60) -> bool:
        """Whether the encodings of two tokens stay apart when their bytes meet.

        The right edge of ``u`` grows from a byte up its right parts, the left edge of ``t`` up
        its left parts. Two edges that exist at the same time merge if their pair comes before
        the merges that end them; of equal pairs the left one comes first.
        """
        rights, lefts = [u], [t]
        while rights[-1] in self.right:
            rights.append(self.right[rights[-1]])
        while lefts[-1] in self.left:
            lefts.append(self.left[lefts[-1]])
        i, j, born, never = len(rights) - 1, len(lefts) - 1, self.born, 1 << 61
        while True:
            end_u = born[rights[i - 1]] if i else never
            end_t = born[lefts[j - 1]] if j else never
            met = self.rank.get((rights[i], lefts[j]))
            if met is not None and met < before and met < end_u and met <= end_t:
                return False
            if i == 0 and j == 0:
                return True
            if end_u <= end_t:
                i -= 1
            else:
                j -= 1

    def encode_words(self, words: Iterable[bytes]) -> Iterator[tuple[bytes, tuple[int, ...]]]:
        """Encodings of distinct words; the states of shared prefixes are computed once."""
        moves, ending, shorter, size, pairs = self.moves, self.ending, self.shorter, self.size, self.pairs
        # Of the path's first d bytes: the last token, and the node of the longest end that the trie has.
        last, nodes = [-1], [0]
        before = b""
        for word in sorted(words):
            shared, most = 0, min(len(word), len(before))
            while shared < most and word[shared] == before[shared]:
                shared += 1
            del last[shared + 1 :], nodes[shared + 1 :]
            node = nodes[shared]
            for end in range(shared + 1, len(word) + 1):
                key = node << 8 | word[end - 1]
                node = moves.get(key, -1)
                if node < 0:
                    if len(moves) >= CACHED_MOVES:
                        moves.clear()
                    node = moves[key] = self.step(key >> 8, key & 255)
                token = ending[node]
                while token >= 0:
                    start = end - size[token]
                    if not start:
                        break
                    pair = last[start] << 32 | token
                    good = pairs.get(pair)
                    if good is None:
                        if len(pairs) >= CACHED_PAIRS:
                            pairs.clear()
                        good = pairs[pair] = self.fits(last[start], token)
                    if good:
                        break
                    token = shorter[token]
                else:
                    raise ValueError("the vocabulary lacks a byte")
                last.append(token)
                nodes.append(node)
            ids, at = [], len(word)
            while at:
                ids.append(last[at])
                at -= size[last[at]]
            yield word, tuple(reversed(ids))
            before = word


class Encoder:
    """Encodes whole texts, with bounded caches of words and of the pieces between spaces."""

    def __init__(self, spec: str):
        self.vocabulary = Vocabulary(spec)
        self.split_words = regex.compile(WORDS)
        special = sorted(self.vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.words: dict[str, bytes] = {}
        self.pieces: dict[str, bytes] = {}
        table = self.vocabulary.bytes_of
        self.sizes = np.array([len(table.get(i, b"")) for i in range(max(table) + 1)], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(table.get(i, b"") for i in range(max(table) + 1)), np.uint8)

    def learn(self, words: set[str]) -> None:
        new = words.difference(self.words)
        if len(self.words) + len(new) > CACHED_WORDS:
            self.words.clear()
            new = words
        by_bytes = {w.encode(): w for w in new}
        for raw, ids in self.vocabulary.encode_words(by_bytes):
            self.words[by_bytes[raw]] = little_endian(ids)

    def of_words(self, words: list[str]) -> bytes:
        self.learn(set(words))
        return b"".join(map(self.words.__getitem__, words))

    def of_pieces(self, pieces: list[str]) -> bytes:
        """The ids of pieces of a text, each with the space before it."""
        new = set(pieces).difference(self.pieces)
        if len(self.pieces) + len(new) > CACHED_PIECES:
            self.pieces.clear()
            new = set(pieces)
        if new:
            split = {piece: self.split_words.findall(" " + piece) for piece in new}
            self.learn({word for words in split.values() for word in words})
            known = self.words
            for piece, words in split.items():
                self.pieces[piece] = b"".join([known[w] for w in words])
        return b"".join(map(self.pieces.__getitem__, pieces))

    def plain(self, text: str) -> Iterator[bytes]:
        """Ids of a text without special tokens, a bounded part of it at a time.

        A word never goes on past a space, unless white space stands on both of its sides; so
        texts without such a place are cut at their spaces, and the pieces are looked up whole.
        """
        if ODD_SPACE.search(text):
            found = (m[0] for m in self.split_words.finditer(text))
            while chunk := list(islice(found, CHUNK_WORDS)):
                yield self.of_words(chunk)
            return
        first, space, rest = text.partition(" ")
        yield self.of_words(self.split_words.findall(first))
        while space:
            if len(rest) <= LONG_TEXT:
                yield self.of_pieces(rest.split(" "))
                return
            cut = rest.find(" ", LONG_TEXT)
            head, space, rest = (rest, "", "") if cut < 0 else (rest[:cut], " ", rest[cut + 1 :])
            yield self.of_pieces(head.split(" "))

    def encode(self, text: str) -> Iterator[bytes]:
        """The ids as little-endian unsigned 32-bit integers, in parts."""
        special = self.vocabulary.special
        if self.special is None or not any(x in text for x in special):
            yield from self.plain(text)
            return
        for part in self.special.split(text):
            if part in special:
                yield little_endian([special[part]])
            elif part:
                yield from self.plain(part)

    def decode(self, ids: bytes) -> bytes:
        found = np.frombuffer(ids, "<u4").astype(np.int64)
        sizes = self.sizes[found]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        shift = np.repeat(self.starts[found] - ends + sizes, sizes)
        return self.flat[shift + np.arange(ends[-1])].tobytes()


_ENCODERS: dict[str, Encoder] = {}


def encoder_for(spec: str) -> Encoder:
    """One encoder per worker process and vocabulary, so that its cache serves many tasks."""
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(spec)
    return _ENCODERS[key]


def _encoded(batches: Iterable[pa.RecordBatch], encoder: Encoder, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Ids and digests of ``(doc_id, text)``; few rows go out at a time, as ids take as much memory as texts."""
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids
    for batch in batches:
        for low in range(0, max(batch.num_rows, 1), ROWS_AT_ONCE):
            part = batch.slice(low, ROWS_AT_ONCE)
            rows = []
            for one in part.column(1):
                n, ids_hash, text_hash, kept = 0, hashlib.sha256(), hashlib.sha256(), []
                for ids in encoder.encode(one.as_py()):
                    n += len(ids) // 4
                    ids_hash.update(ids)
                    text_hash.update(encoder.decode(ids))
                    if with_ids:
                        kept.append(ids)
                rows.append((n, ids_hash.hexdigest(), text_hash.hexdigest(), b"".join(kept)))
            columns = [
                part.column(0),
                pa.array([r[0] for r in rows], pa.int64()),
                pa.array([r[1] for r in rows], pa.string()),
                pa.array([r[2] for r in rows], pa.string()),
            ]
            if with_ids:
                columns.append(pa.array([np.frombuffer(r[3], "<i4") for r in rows], pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(columns, names)


def encode(docs: DataFrame, vocabulary: str, with_ids: bool = False, text: str = "text") -> DataFrame:
    """Token counts and digests of whole texts, and the ids themselves with ``with_ids``.

    ``vocabulary`` is the path of a byte-level BPE file that the driver can read; its content
    (bounded by the file) goes to the executors. Returns ``doc_id``, ``n_tokens``, ``ids_sha256``
    (ids as little-endian unsigned 32-bit integers), ``decoded_sha256`` (the text decoded from the
    ids, in UTF-8) and, if asked for, ``ids``. Other columns are dropped.

    A null text is the empty text: no tokens, digests of nothing. Rows are handled one by one, so
    repeated rows, null ids and an empty table need nothing special; a very long text is encoded
    in pieces between words.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _encoded(batches, encoder_for(spec.value), with_ids)

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    chosen = docs.select(name("doc_id").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    return chosen.mapInArrow(run, schema + (", ids array<int>" if with_ids else ""))


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """The texts (``doc_id``, ``text``) of encoded documents (``doc_id``, ``ids``).

    Null ids give a null text, no ids the empty text; bytes that aren't UTF-8 become U+FFFD.
    """
    with open(vocabulary, encoding="utf-8") as file:
        spec = encoded.sparkSession.sparkContext.broadcast(file.read())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_for(spec.value)
        for batch in batches:
            texts = [
                None if x.as_py() is None else encoder.decode(little_endian(x.as_py())).decode("utf-8", "replace")
                for x in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"]
            )

    return encoded.select(name("doc_id").cast("long").alias("doc_id"), name("ids")).mapInArrow(
        run, "doc_id long, text string"
    )
