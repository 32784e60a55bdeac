"""Document fingerprints by a randomised embedding of edit distance into Hamming distance.

All documents share one random walk: at step ``j`` the embedding repeats the current character, and a
coin that depends on ``j`` and the character alone decides whether the walk moves on to the next one.
After an insertion or deletion two walks soon fall into step again, so texts at a small edit distance
have embeddings that agree in most places. A fingerprint samples fixed places of the embedding;
groups of its samples are band keys that find likely copies, which are then verified.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.llm.common import name, text_of
from sparkscour.llm.components import components
from sparkscour.llm.jaccard_tiles import BLOCK, PAIR, _tiles
from sparkscour.session import durable

SAMPLES = 96
BANDS = 16
# Share of samples in which unrelated prose agrees by chance.
CHANCE = 0.1
# The coins repeat after this many steps; 32 classes of characters have coins of their own.
PERIOD = 1 << 16
CLASSES = 32
SEED = 20240601
# Characters that are walked at once, and documents below which they are walked one by one.
WALK_CHARS = 1 << 24
FEW = 24
# Likeness of near copies, at least; their edit distance is at most the rest of the longer text.
LEAST = 0.7
# Partners of a text that are compared before all others, and bits of the filter of texts.
BEST = 2
FILTER_BITS = 1 << 24
# Pairs of a block that are compared at once, and pairs that are held before they go out.
AT_ONCE = 1 << 12
HELD_PAIRS = 1 << 16
# Characters that must agree where two texts are brought into step again, and how far that is looked for.
STEP, REACH = 8, 200
# Columns of a text's sketch.
SKETCH = ["sketch0", "sketch1", "sketch2"]


@lru_cache(maxsize=1)
def gaps() -> np.ndarray:
    """Steps until the walk leaves a character of a class that it meets at a step (at most 64)."""
    coins = np.random.Generator(np.random.PCG64(SEED)).integers(0, 2, (CLASSES, PERIOD), dtype=np.uint8)
    coins[:, ::64] = 1
    out = np.empty((CLASSES, PERIOD), np.uint8)
    wait = np.ones(CLASSES, np.uint8)
    for j in range(PERIOD - 1, -1, -1):
        wait = np.where(coins[:, j] == 1, 1, wait + 1).astype(np.uint8)
        out[:, j] = wait
    return out.reshape(-1)


@lru_cache(maxsize=64)
def places(scale: int) -> np.ndarray:
    """The sampled steps of a scale, anywhere below ``2 ** (scale + 1)``."""
    return np.sort(np.random.Generator(np.random.PCG64([SEED, scale])).integers(0, 2 << scale, SAMPLES))


def mixed(codes: np.ndarray) -> np.ndarray:
    return (codes * np.uint32(2654435761)) & np.uint32(0xFFFFFFFF)


def walk(base: np.ndarray, starts: np.ndarray, sizes: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The step at which each character is entered, and the step at which each text ends.

    The texts lie one after the other in ``base`` (character classes times ``PERIOD``); ``begin`` has
    the steps at which their walks start. All texts advance together, the longest go on alone.
    """
    table, small = gaps(), gaps().tobytes()
    order = np.argsort(-sizes, kind="stable")
    length, at, step = sizes[order], starts[order].copy(), begin[order].astype(np.int64)
    entered = np.empty(len(base), np.int64)
    active = np.searchsorted(-length, 0, side="left")
    done, i = np.zeros(len(order), np.int64), 0
    while active > FEW:
        until = int(length[active - 1])
        a, s = at[:active], step[:active]
        while i < until:
            entered[a] = s
            s += table.take(base.take(a) | (s & (PERIOD - 1)))
            a += 1
            i += 1
        done[:active] = i
        active = int(np.searchsorted(-length, -i, side="left"))
    for k in range(active):
        j, from_ = int(step[k]), int(at[k])
        here = []
        for b in base[from_ : from_ + int(length[k] - done[k])].tolist():
            here.append(j)
            j += small[b | (j & (PERIOD - 1))]
        entered[from_ : from_ + len(here)] = here
        step[k] = j
    ends = np.empty(len(order), np.int64)
    ends[order] = step
    return entered, ends


def scale_of(n: int) -> int:
    return n.bit_length()


def sample(entered: np.ndarray, end: int, symbols: np.ndarray) -> bytes:
    """Scale, then the samples at that scale and at the next, two to a byte; 0 is past the end."""
    n = len(entered)
    scale = scale_of(n)
    out = [bytes([scale])]
    for level in (scale, scale + 1):
        steps = places(level)
        found = np.zeros(SAMPLES, np.uint8)
        if n:
            inside = steps < end
            at = np.searchsorted(entered, steps[inside], side="right") - 1
            found[inside] = symbols[at]
        out.append((found[::2] << 4 | found[1::2]).tobytes())
    return b"".join(out)


def level_samples(print_: bytes, level: int) -> np.ndarray | None:
    at = level - print_[0]
    if at not in (0, 1):
        return None
    half = np.frombuffer(print_, np.uint8)[1 + at * SAMPLES // 2 : 1 + (at + 1) * SAMPLES // 2]
    return np.stack([half >> 4, half & 15], axis=1).reshape(-1)


def likeness(a: bytes, b: bytes) -> float:
    """Share of agreeing samples at the finest common scale, less what agrees by chance; from 0 to 1.

    Equal fingerprints give 1; texts of no common scale (one more than about twice as long) give 0.
    """
    if a == b:
        return 1.0
    level = max(a[0], b[0])
    x, y = level_samples(a, level), level_samples(b, level)
    if x is None or y is None:
        return 0.0
    either = (x > 0) | (y > 0)
    if not either.any():
        return 0.0
    share = float((x == y)[either].mean())
    return max(0.0, (share - CHANCE) / (1 - CHANCE))


def band_keys(print_: bytes) -> list[str]:
    """A key per band and scale, of samples dealt to bands in turn.

    Bands most of whose samples are past the text's end are left out, as all short texts share them.
    """
    keys = []
    for level in (print_[0], print_[0] + 1):
        samples = level_samples(print_, level)
        for band in range(BANDS):
            part = samples[band::BANDS]
            if 3 * np.count_nonzero(part) >= 2 * len(part):
                keys.append(f"{level}.{band}.{part.tobytes().hex()}")
    return keys


def prints_of(texts: list[str], tails: list[str | None]) -> Iterator[tuple[bytes, bytes | None]]:
    """Fingerprints of texts, and of each with its last quarter replaced by a tail (None: not asked)."""
    low = 0
    while low < len(texts):
        high, chars = low, 0
        while high < len(texts) and (high == low or chars + len(texts[high]) <= WALK_CHARS):
            chars += len(texts[high])
            high += 1
        yield from _prints_of(texts[low:high], tails[low:high])
        low = high


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    mix = mixed(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    sizes = np.array([len(t) for t in texts], np.int64)
    base = (mix >> np.uint32(27)).astype(np.int64) * PERIOD
    symbols = ((mix >> np.uint32(20)) & np.uint32(127)).astype(np.uint8) % 15 + 1
    return base, symbols, np.cumsum(sizes) - sizes, sizes


def _prints_of(texts: list[str], tails: list[str | None]) -> Iterator[tuple[bytes, bytes | None]]:
    base, symbols, starts, sizes = _coded(texts)
    entered, ends = walk(base, starts, sizes, np.zeros(len(texts), np.int64))
    # An edited text shares the walk of what it keeps, so only its tail is walked anew.
    cuts = sizes - sizes // 4
    at_cut = np.array(
        [ends[k] if cuts[k] == sizes[k] else entered[starts[k] + cuts[k]] for k in range(len(texts))], np.int64
    )
    tail_base, tail_symbols, tail_starts, tail_sizes = _coded([t or "" for t in tails])
    tail_entered, tail_ends = walk(tail_base, tail_starts, tail_sizes, at_cut)
    for k, tail in enumerate(tails):
        a, b, c = starts[k], starts[k] + sizes[k], starts[k] + cuts[k]
        own = sample(entered[a:b], ends[k], symbols[a:b])
        edited = None
        if tail is not None:
            x, y = tail_starts[k], tail_starts[k] + tail_sizes[k]
            edited = sample(
                np.concatenate([entered[a:c], tail_entered[x:y]]),
                tail_ends[k],
                np.concatenate([symbols[a:c], tail_symbols[x:y]]),
            )
        yield own, edited


DONE, PENDING, HEAD = 0, 1, 2
SCHEMA = (
    "role int, part int, doc_id long, n_chars long, edited_sha256 string, print binary, "
    "edited_print binary, near_edited double, near_next double, shared_bands long, node long, text string"
)
FIELDS = [
    ("role", pa.int32()), ("part", pa.int32()), ("doc_id", pa.int64()), ("n_chars", pa.int64()),
    ("edited_sha256", pa.string()), ("print", pa.binary()), ("edited_print", pa.binary()),
    ("near_edited", pa.float64()), ("near_next", pa.float64()), ("shared_bands", pa.int64()),
    ("node", pa.int64()), ("text", pa.string()),
]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(FIELDS)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, (_, t) in zip(columns, FIELDS)], [n for n, _ in FIELDS]
    )


def _done(
    part: int, doc: int | None, node: int, text: str, own: bytes, edited: bytes, tail: str, after: bytes
) -> tuple:
    n = len(text)
    changed = text[: n - n // 4] + tail
    digest = hashlib.sha256(changed.encode("utf-8", "surrogatepass")).hexdigest()
    shared = len(set(band_keys(own)) & set(band_keys(edited)))
    near = likeness(own, edited), likeness(own, after)
    return (DONE, part, doc, n, digest, own, edited, *near, shared, node, None)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents of a sorted partition, each with the one after it; the last one stays pending."""
    context = TaskContext.get()
    part = context.partitionId() if context else 0
    held: tuple | None = None  # document, text, fingerprint and hash that wait for the next one
    for batch in batches:
        docs, texts, hashes = (c.to_pylist() for c in batch.columns)
        if not docs:
            continue
        before = [held[1]] if held else []
        line = before + texts
        tails = [line[k + 1][: len(line[k]) // 4] for k in range(len(line) - 1)] + [None]
        prints = list(prints_of(line, tails))
        ids = ([held[0]] if held else []) + docs
        nodes = ([held[3]] if held else []) + hashes
        rows = []
        if held is None:
            rows.append((HEAD, part, docs[0], None, None, prints[0][0], None, None, None, None, None, texts[0]))
        for k in range(len(line) - 1):
            rows.append(_done(part, ids[k], nodes[k], line[k], *prints[k], tails[k], prints[k + 1][0]))
        held = ids[-1], line[-1], prints[-1][0], nodes[-1]
        yield _batch(rows)
    if held:
        yield _batch([(PENDING, part, held[0], None, None, held[2], None, None, None, None, held[3], held[1])])


def _at_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for part, doc, node, text, after, after_text in zip(*(c.to_pylist() for c in batch.columns)):
            tail = after_text[: len(text) // 4]
            own, edited = next(prints_of([text], [tail]))
            rows.append(_done(part, doc, node, text, own, edited, tail, after))
        yield _batch(rows)


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """Fingerprints of all documents and of their edited texts.

    The edited text has its last quarter replaced by as many first characters of the next document in
    ascending ``doc_id`` (equal ids by text, null last; after the last comes the first). Returns
    ``doc_id``, ``n_chars``, ``edited_sha256``, ``print`` and ``edited_print`` (binary), ``near_edited``,
    ``near_next``, ``shared_bands``, the band keys that a text and its edited text have in common, and
    ``node``, the 64-bit hash of the text.

    Texts are shuffled once, into ranges of ids; a sorted range knows each next document but for its
    last one, and these few, one per range, are joined to the first ones of the ranges after them. A
    null text is empty; the only document is its own next one; an empty table gives no rows. Other
    columns are dropped.
    """
    chosen = docs.select(
        name("doc_id").cast("long").alias("doc_id"), text_of(docs, text).alias("text")
    ).withColumns({"nodoc": F.col("doc_id").isNull(), "tie": F.xxhash64("text")})
    order = ["nodoc", "doc_id", "tie"]
    ranged = chosen.repartitionByRange(*order).sortWithinPartitions(*order)
    along = durable(ranged.select("doc_id", "text", "tie").mapInArrow(_along, SCHEMA))
    heads = along.filter(F.col("role") == HEAD).select(
        F.col("part").alias("next_part"), F.col("print").alias("after"), F.col("text").alias("after_text")
    )
    # One row per range.
    parts = along.filter(F.col("role") == HEAD).select("part")
    ordered = Window.orderBy("part")
    following = parts.select(
        "part",
        F.coalesce(
            F.lead("part").over(ordered), F.first("part").over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        ).alias("next_part"),
    )
    ends = (
        along.filter(F.col("role") == PENDING)
        .select("part", "doc_id", "node", "text")
        .join(following, "part")
        .join(heads, "next_part")
        .select("part", "doc_id", "node", "text", "after", "after_text")
        .mapInArrow(_at_ends, SCHEMA)
    )
    ends = durable(ends)
    return along.filter(F.col("role") == DONE).unionByName(ends).drop("role", "part", "text")


class Side:
    """Texts as arrays: name, length, component, and the samples of both scales."""

    def __init__(self, nodes: pa.Array, sizes: pa.Array, labels: pa.Array, prints: pa.Array):
        self.node, self.n, self.label = (x.to_numpy(zero_copy_only=False) for x in (nodes, sizes, labels))
        raw = np.frombuffer(b"".join(prints.to_pylist()), np.uint8).reshape(len(self.node), 1 + SAMPLES)
        half = raw[:, 1:].reshape(-1, 2, SAMPLES // 2)
        self.scale = raw[:, 0].astype(np.int64)
        self.samples = np.stack([half >> 4, half & 15], axis=-1).reshape(-1, 2, SAMPLES)


def likenesses(a: Side, i: np.ndarray, b: Side, j: np.ndarray) -> np.ndarray:
    """``likeness`` of the texts ``i`` of one side with the texts ``j`` of another."""
    p, q = a.scale[i], b.scale[j]
    level = np.maximum(p, q)
    x, y = a.samples[i, np.minimum(level - p, 1)], b.samples[j, np.minimum(level - q, 1)]
    either = (x > 0) | (y > 0)
    n = either.sum(axis=1)
    share = ((x == y) & either).sum(axis=1) / np.maximum(n, 1)
    near = np.maximum(0.0, (share - CHANCE) / (1 - CHANCE))
    same = (p == q) & (a.samples[i] == b.samples[j]).all(axis=(1, 2))
    return np.where(same, 1.0, np.where((np.abs(p - q) <= 1) & (n > 0), near, 0.0))


def sketches(side: Side) -> np.ndarray:
    """One bit of each sample of both scales, eight to a byte."""
    return np.packbits(side.samples & 1, axis=-1)


def most_differing(least: float) -> float:
    # Samples with different bits differ, and all samples count at most.
    return SAMPLES * (1 - CHANCE) * (1 - least) + 1e-6


def may_be_alike(p: np.ndarray, x: np.ndarray, q: np.ndarray, y: np.ndarray, most: float) -> np.ndarray:
    """Whether the sketches ``x`` and ``y`` of scales ``p`` and ``q`` leave open that texts are alike."""
    at, level = np.arange(len(p)), np.maximum(p, q)
    differ = x[at, np.minimum(level - p, 1)] ^ y[at, np.minimum(level - q, 1)]
    return (np.abs(p - q) <= 1) & (np.bitwise_count(differ).sum(axis=1) <= most)


def most_edits(n, least: float):
    return np.floor(n * (1 - least)).astype(np.int64)


def _postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text and band key, the keys of ``band_keys`` as numbers, with the text's sketch as numbers."""
    for batch in batches:
        if not batch.num_rows:
            continue
        side = Side(batch.column(0), batch.column(1), batch.column(0), batch.column(2))
        # Samples are dealt to bands in turn.
        dealt = side.samples.reshape(-1, 2, SAMPLES // BANDS, BANDS)
        key = np.zeros((len(side.node), 2, BANDS), np.int64)
        for k in range(SAMPLES // BANDS):
            key = key << 4 | dealt[:, :, k]
        place = (side.scale[:, None, None] + np.arange(2)[:, None]) * BANDS + np.arange(BANDS)
        key |= place << 4 * (SAMPLES // BANDS)
        full = 3 * np.count_nonzero(dealt, axis=2) >= 2 * (SAMPLES // BANDS)
        rows = np.nonzero(full)[0]
        sketch = sketches(side).reshape(len(side.node), -1).view(np.int64)[rows]
        yield pa.RecordBatch.from_arrays(
            [pa.array(x) for x in (key[full], side.node[rows], side.n[rows], *sketch.T.copy())],
            ["token", "node", "n", *SKETCH],
        )


def _near_pairs(least: float):
    """Each text of a block with the shortest of a compatible length, and with the one before it.

    Pairs whose sketches rule out that they are alike are left out, so that they aren't shuffled.
    """
    most = most_differing(least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.empty((0, 2), np.int64)]
            for row in zip(*batch.columns):
                ids, n, *sketch = (x.values.to_numpy() for x in row)
                bits = np.stack(sketch, axis=1).view(np.uint8).reshape(len(n), 2, -1)
                scale = np.frexp(n.astype(np.float64))[1].astype(np.int64)
                at, low = np.arange(len(n)), n - most_edits(n, least)
                first = np.searchsorted(n, low)
                far, next_ = first < at, np.flatnonzero(n[:-1] >= low[1:])
                i, j = np.concatenate([first[far], next_]), np.concatenate([at[far], next_ + 1])
                good = may_be_alike(scale[i], bits[i], scale[j], bits[j], most)
                found.append(np.stack([ids[i[good]], ids[j[good]]], axis=1))
            pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scale and one bit of each sample of both scales."""
    for batch in batches:
        if batch.num_rows:
            side = Side(batch.column(0), batch.column(1), batch.column(0), batch.column(2))
            bits = sketches(side).reshape(batch.num_rows, -1)
            rows = np.concatenate([side.scale[:, None].astype(np.uint8), bits], axis=1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in rows], pa.binary())], ["node", "sketch"])


def _maybe_alike(least: float):
    """The pairs whose sketches do not rule out that their fingerprints are alike."""
    most = most_differing(least)

    def side(sketches: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(sketches.to_pylist()), np.uint8).reshape(len(sketches), 1 + SAMPLES // 4)
        return raw[:, 0].astype(np.int64), raw[:, 1:].reshape(-1, 2, SAMPLES // 8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            good = may_be_alike(*side(batch.column(2)), *side(batch.column(3)), most)
            yield pa.RecordBatch.from_arrays(batch.columns[:2], ["a", "b"]).filter(pa.array(good))

    return run


def _alike(least: float):
    """The pairs whose fingerprints are alike, with their likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b, n, m, x, y = (batch.column(k) for k in range(6))
            if batch.num_rows:
                at = np.arange(batch.num_rows)
                near = likenesses(Side(a, n, a, x), at, Side(b, m, b, y), at)
                good = pa.array(near >= least)
                yield pa.RecordBatch.from_arrays([a, b, pa.array(near)], ["a", "b", "likeness"]).filter(good)

    return run


def _met(left: Side, right: Side, least: float, best: int | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Pairs of one or two blocks, of different components, that are alike; how much; whether ``best`` left any out."""

    def alike(i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        far = most_edits(np.maximum(left.n[i], right.n[j]), least)
        good = (left.label[i] != right.label[j]) & (np.abs(left.n[i] - right.n[j]) <= far)
        i, j = i[good], j[good]
        near = likenesses(left, i, right, j)
        good = near >= least
        return i[good], j[good], near[good]

    n, found, likes, cut = len(left.node), [np.empty((0, 2), np.int64)], [np.empty(0)], False
    if left is right and n * (n - 1) // 2 <= AT_ONCE:
        i, j, near = alike(*np.triu_indices(n, 1))
        if best is None or np.bincount(np.concatenate([i, j]), minlength=1).max() <= best:
            return np.stack([left.node[i], left.node[j]], axis=1), near, False
    every = np.arange(len(right.node))
    for k in range(n):
        i, j, near = alike(np.full(len(every), k), every)
        if best is not None and len(j) > best:
            most = np.argpartition(-near, best)[:best]
            i, j, near, cut = i[:best], j[most], near[most], True
        found.append(np.stack([left.node[i], right.node[j]], axis=1))
        likes.append(near)
    return np.concatenate(found), np.concatenate(likes), cut


def _blocks(least: float, best: int | None, liked: bool = False):
    """Pairs of texts of different components in one or two blocks of a band that are alike.

    With ``best``, of each text only so many, those that are most alike; a third column then names the
    bands (without pair) of which some were left out. With ``liked``, a last column has the likeness.
    """

    def side(rows: pa.Array) -> Side:
        return Side(*rows.flatten())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, likes, cuts = [], [], []

            def emit() -> pa.RecordBatch:
                pairs, at = np.unique(np.sort(np.concatenate(found), axis=1), axis=0, return_index=True)
                gone, long = pa.nulls(len(cuts), pa.int64()), pa.int64()
                columns = {x: pa.concat_arrays([pa.array(pairs[:, k], long), gone]) for k, x in enumerate("ab")}
                if best is not None:
                    columns["tile"] = pa.concat_arrays([pa.nulls(len(pairs), long), pa.array(cuts, long)])
                if liked:
                    near = pa.array(np.concatenate(likes)[at])
                    columns["likeness"] = pa.concat_arrays([near, pa.nulls(len(cuts), pa.float64())])
                found.clear()
                likes.clear()
                cuts.clear()
                return pa.RecordBatch.from_pydict(columns)

            for k in range(batch.num_rows):
                left = side(batch.column(0)[k].values)
                right = side(batch.column(1)[k].values) if batch.column(1)[k].is_valid else left
                pairs, near, cut = _met(left, right, least, best)
                found.append(pairs)
                likes.append(near)
                if cut:
                    cuts.append(batch.column(2)[k].as_py())
                if sum(map(len, found[-2:])) and sum(map(len, found)) >= HELD_PAIRS:
                    yield emit()
            if found:
                yield emit()

    return run


def shared(a: str, i: int, b: str, j: int) -> int:
    """How many characters agree from two places on."""
    k, n, most = 0, 16, min(len(a) - i, len(b) - j)
    while k < most and a[i + k : i + k + n] == b[j + k : j + k + n]:
        k, n = k + n, 2 * n
    while n and k < most:
        if a[i + k : i + k + n] == b[j + k : j + k + n]:
            k += n
        n //= 2
    return min(k, most)


def edits(a: str, b: str, most: int) -> int:
    """The edit distance; -1 above ``most``.

    A few edits are found by the furthest places that each number of them reaches on each diagonal,
    more by whole columns of differences as bits of a number.
    """
    if abs(len(a) - len(b)) > most:
        return -1
    a, b = (a, b) if len(a) >= len(b) else (b, a)
    n, m = len(a), len(b)
    reach = {0: shared(a, 0, b, 0)}
    if not m or n == m == reach[0]:
        return n - m
    for e in range(1, min(most, int(n**0.5)) + 1):
        now = {}
        for k in range(max(-e, -n), min(e, m) + 1):
            i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2), reach.get(k + 1, -2) + 1)
            i = min(i, n, m - k)
            if i < 0 or i + k < 0:
                continue
            now[k] = i = i + shared(a, i, b, i + k)
            if i == n and i + k == m:
                return e
        reach = now
    if most <= int(n**0.5):
        return -1
    at: dict[str, int] = {}
    for i, c in enumerate(b):
        at[c] = at.get(c, 0) | 1 << i
    every, top, score = (1 << m) - 1, m - 1, m
    up, down = every, 0
    for left, c in zip(range(n - 1, -1, -1), a):
        eq = at.get(c, 0)
        x = eq | down
        h = (((eq & up) + up) ^ up) | eq
        more, less = (down | ~(h | up)) & every, up & h
        score += (more >> top) - (less >> top & 1)
        if score - left > most:
            return -1
        more, less = more << 1 | 1, less << 1
        up, down = (less | ~(x | more)) & every, more & x & every
    return score if score <= most else -1


def within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance is at most ``most``.

    Often a bound from above tells: what lies between the common beginning and end, or the edits made by
    walking along both texts and bringing them into step again where they differ. Else the distance does.
    """
    if abs(len(a) - len(b)) > most:
        return False
    at = shared(a, 0, b, 0)
    x, y = a[at:][::-1], b[at:][::-1]
    at = shared(x, 0, y, 0)
    x, y = x[at:], y[at:]
    if max(len(x), len(y)) <= most:
        return True
    i = j = made = 0
    while made <= most:
        k = shared(x, i, y, j)
        i, j = i + k, j + k
        if i >= len(x) or j >= len(y):
            break
        ahead = x.find(y[j : j + STEP], i + 1, i + REACH)
        back = y.find(x[i : i + STEP], j + 1, j + REACH)
        if x[i + 1 : i + 1 + STEP] == y[j + 1 : j + 1 + STEP] or ahead < 0 and back < 0:
            i, j, made = i + 1, j + 1, made + 1
        elif back < 0 or 0 <= ahead and ahead - i <= back - j:
            i, made = ahead, made + ahead - i
        else:
            j, made = back, made + back - j
    return made + max(len(x) - i, len(y) - j) <= most or edits(x, y, most) >= 0


def _within(least: float, measured: bool = True):
    """The pairs of texts within the bound of edits, with their distance if that is asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())
            bounded = [(x, y, int(most_edits(max(len(x), len(y)), least))) for x, y in texts]
            far = [edits(*z) if measured else None if within(*z) else -1 for z in bounded]
            made = [*batch.columns[:3], pa.array(far, pa.int32())]
            good = pa.array([d is None or d >= 0 for d in far], pa.bool_())
            yield pa.RecordBatch.from_arrays(made, ["a", "b", "likeness", "distance"]).filter(good)

    return run


LINKS = "a long, b long, likeness double"


class Search:
    """One search for near copies among distinct texts (``node``): their links and components.

    ``printed`` has ``doc_id``, ``node``, ``n_chars`` and ``print`` of each document, ``docs`` their texts.
    Texts of a band are first compared with the shortest one of a compatible length and the one before.
    Then, in bands whose texts are not all in one component, each text is compared with those of other
    components that are most alike, and at last, in bands where that left some out, with all that are alike,
    block by block. So any two texts that share a band key are in one component or were compared. Links have
    a ``distance`` if it is ``measured``; else it is null, and only known to be within the bound.
    """

    def __init__(self, docs: DataFrame, printed: DataFrame, least: float = LEAST, text: str = "text", measured: bool = True):
        self.least, self.measured = least, measured
        self.texts = docs.select(text_of(docs, text).alias("text")).select(F.xxhash64("text").alias("node"), "text")
        some = printed.filter(F.col("n_chars") > 0)
        self.nodes = durable(
            some.groupBy("node").agg(
                F.min("doc_id").alias("least"), F.first("n_chars").alias("n"), F.first("print").alias("print")
            )
        )
        self.links, self.labels = self._found()

    def _alike(self, pairs: DataFrame) -> DataFrame:
        side = lambda k, n, x: self.nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("print").alias(x))
        both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
        return durable(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_alike(self.least), LINKS))

    def _texts_of(self, pairs: DataFrame) -> DataFrame:
        """One text of each node in the pairs; a bitmap of hashes keeps most others out of the shuffle."""
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node"))
        place = F.pmod("node", F.lit(FILTER_BITS)) + 1
        maps = (
            wanted.groupBy(F.bitmap_bucket_number(place).alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
            .collect()
        )
        flags = np.zeros(FILTER_BITS // 8, np.uint8)
        for row in maps:
            size = len(row["map"])
            flags[(row["part"] - 1) * size : row["part"] * size] = np.frombuffer(row["map"], np.uint8)
        shared = self.texts.sparkSession.sparkContext.broadcast(flags)

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = shared.value
            for batch in batches:
                at = batch.column(0).to_numpy() % FILTER_BITS
                yield batch.filter(pa.array((known[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))

        texts = self.texts.mapInArrow(likely, "node long, text string")
        return texts.join(wanted.distinct(), "node", "left_semi").dropDuplicates(["node"])

    def _verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs within the bound of edits, with their ``distance`` if it is measured."""
        texts = self._texts_of(pairs)
        both = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(
            texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b"
        )
        columns = ("a", "b", "likeness", "x", "y")
        return durable(both.select(*columns).mapInArrow(_within(self.least, self.measured), f"{LINKS}, distance int"))

    def _open(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """The members of bands that hold several components."""
        known = members.drop("label").join(labels.select("node", F.col("component").alias("label")), "node", "left")
        known = known.withColumn("label", F.coalesce("label", "node"))
        held = known.groupBy("tile").agg(
            F.min("label").alias("low"), F.max("label").alias("high"), F.count(F.lit(1)).alias("size")
        )
        # Of three texts, all pairs of compatible lengths were compared at first.
        held = held.filter((F.col("low") != F.col("high")) & (F.col("size") > 3)).select("tile")
        return durable(known.join(held, "tile"))

    def _meetings(self, members: DataFrame) -> DataFrame:
        """Blocks with themselves (``other`` is null) and with later ones of their band, and its name."""
        def blocks(some: DataFrame) -> DataFrame:
            return some.join(self.nodes.select("node", "print"), "node").groupBy("tile", "block").agg(
                F.min("n").alias("low"),
                F.max("n").alias("high"),
                F.collect_list(F.struct("node", "n", "label", "print")).alias("rows"),
            )

        rows = blocks(members)
        inside = rows.select("rows", F.lit(None).cast(rows.schema["rows"].dataType).alias("other"), "tile")
        long = members.filter(F.col("block") > 0).select("tile").distinct()
        if long.isEmpty():
            return inside
        many = durable(blocks(members.join(long, "tile", "left_semi")))
        left = many.select("tile", F.col("block").alias("i"), F.col("high").alias("top"), "rows")
        right = many.select("tile", F.col("block").alias("j"), F.col("low").alias("bottom"), F.col("rows").alias("other"))
        # Blocks are in order of length, so only near ones are compatible.
        meet = (F.col("i") < F.col("j")) & (F.col("bottom") - F.col("top") <= F.floor(F.col("bottom") * F.lit(1 - self.least)))
        return inside.unionByName(left.join(right, "tile").filter(meet).select("rows", "other", "tile"))

    def _found(self) -> tuple[DataFrame, DataFrame]:
        long = "".join(f", {x} %s" for x in SKETCH)
        postings = self.nodes.select("node", "n", "print").mapInArrow(
            _postings, "token long, node long, n long" + long.replace("%s", "long")
        )
        ranged = postings.repartition("token").sortWithinPartitions("token", "n", "node")
        made = ranged.mapInArrow(
            _tiles, "tile long, block int, nodes array<long>, sizes array<long>" + long.replace("%s", "array<long>")
        )
        tiles = durable(made.dropDuplicates(["tile", "block"]))
        near = tiles.select("nodes", "sizes", *SKETCH).mapInArrow(_near_pairs(self.least), PAIR)
        # Dealt by the column that they are joined by next, so that they are shuffled once.
        tried = self._alike(near.repartition("a").distinct())
        links = self._verified(tried)
        labels = durable(components(links))
        # Tiles of up to three texts are never open.
        wide = tiles.filter((F.col("block") > 0) | (F.size("nodes") > min(3, BLOCK - 1)))
        members = wide.select("tile", "block", F.explode(F.arrays_zip("nodes", "sizes")).alias("x"))
        members = self._open(members.select("tile", "block", F.col("x.nodes").alias("node"), F.col("x.sizes").alias("n")), labels)

        def joined(fresh: DataFrame) -> DataFrame:
            """The labels, once links that they don't follow from are added."""
            old = labels.select(F.col("node").alias("a"), F.col("component").alias("b"))
            return durable(components(old.unionByName(fresh.select("a", "b"))))

        fresh = None  # links that the labels don't follow from
        for best in (BEST, None):
            kind = PAIR + ", tile long" * (best is not None) + ", likeness double"
            pairs = self._meetings(members).mapInArrow(_blocks(self.least, best, True), kind)
            cut = None
            if best is not None:
                met = durable(pairs)
                pairs = met.filter(F.col("a").isNotNull()).drop("tile")
                # A band of which nothing was left out has no pair that wasn't compared.
                cut = met.select("tile").filter(F.col("tile").isNotNull()).distinct()
                cut = None if cut.isEmpty() else cut
            more = durable(pairs.distinct().join(tried.select("a", "b"), ["a", "b"], "left_anti"))
            if not more.isEmpty():
                tried = tried.unionByName(more)
                fresh = self._verified(more)
                links = links.unionByName(fresh)
            if cut is None:
                break
            if fresh is not None:
                labels, fresh = joined(fresh), None
            members = self._open(members.join(cut, "tile", "left_semi"), labels)
        if fresh is not None:
            labels = joined(fresh)
        return links, labels

    def classes(self) -> DataFrame:
        """``node`` and ``class_id``, the smallest id of the documents whose texts links reach."""
        named = self.nodes.select("node", "least").join(self.labels, "node", "left")
        named = durable(named.withColumn("component", F.coalesce("component", "node")))
        least = named.groupBy("component").agg(F.min("least").alias("class_id"))
        return named.select("node", "component").join(least, "component").select("node", "class_id")


def fingerprints_with_classes(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """``fingerprints`` with ``class_id``, the smallest id of the near copies that a document belongs to.

    Equal texts are of one class, whatever their ids; rows that repeat an id with other texts are
    documents of their own. Documents without id take part; ``class_id`` is null where a class has no id.
    An empty text is of its own class.
    """
    found = fingerprints(docs, text)
    classes = Search(docs, found, least, text, measured=False).classes()
    own = F.when(F.col("n_chars") > 0, F.col("class_id")).otherwise(F.col("doc_id"))
    return found.join(classes, "node", "left").withColumn("class_id", own).drop("node")


def near_copies(docs: DataFrame, least: float = LEAST, text: str = "text") -> DataFrame:
    """Verified near copies: ``doc_id``, ``leader_id`` (smaller), ``likeness`` and ``distance`` in edits.

    Equal texts link to the smallest id among them. Links between different texts, named by their
    smallest ids, have fingerprints alike by ``least`` and an edit distance of at most ``1 - least`` of the
    longer text; they join all texts of a class (see ``Search``), though not each two of them. Documents
    without id or text are in no pair, but their texts take part.
    """
    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            prints = [p for p, _ in prints_of(texts, [None] * len(texts))]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), sizes, pa.array(prints, pa.binary())], ["doc_id", "node", "n_chars", "print"]
            )

    known = docs.select(name("doc_id").cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    known = known.filter(F.col("text") != "").select("doc_id", F.xxhash64("text").alias("node"), "text")
    printed = durable(known.mapInArrow(keys, "doc_id long, node long, n_chars long, print binary"))
    search = Search(docs, printed, least, text)
    of = lambda k, i: search.nodes.select(F.col("node").alias(k), F.col("least").alias(i))
    others = search.links.join(of("a", "i"), "a").join(of("b", "j"), "b").select(
        F.greatest("i", "j").alias("doc_id"), F.least("i", "j").alias("leader_id"), "likeness", "distance", "i", "j"
    )
    others = others.filter(F.col("i").isNotNull() & F.col("j").isNotNull()).drop("i", "j")
    equal = printed.join(search.nodes.select("node", F.col("least").alias("leader_id")), "node").select(
        "doc_id", "leader_id", F.lit(1.0).alias("likeness"), F.lit(0).alias("distance")
    )
    return equal.unionByName(others).filter(F.col("doc_id") > F.col("leader_id")).distinct()
