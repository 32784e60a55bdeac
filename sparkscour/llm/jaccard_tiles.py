"""Jaccard self-join of word-shingle sets, by size-banded tiles and bitmap signatures.

Equal sets are one node. Two sets that are alike enough share a shingle among the first few of each in
one common order, in which shingles that are frequent come last; the nodes that have such a shingle make a
tile, sorted by size. In a tile only sets of compatible sizes can link. Hashed bitmaps bound the overlap
of two sets from above; pairs that pass are decided by intersecting their sorted arrays of shingles.

Links between different nodes decide components, so a large tile of mutual copies need not form all its
pairs: every node of a tile is first compared with the smallest compatible one and with the one before it.
Then pairs of a tile whose nodes are not yet in one component are left: first each node with the few that
its bitmap allows most, then all that are still open. Their bitmaps are wider, so that few pairs pass that
don't link.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.llm.common import name, packed, text_of, unpacked
from sparkscour.llm.components import components
from sparkscour.session import durable

WORDS = 5
# Similarity of 80 in 100; everything is compared in whole numbers.
PERCENT = 80
# Shingles that go last in the order, at most; the order matters for speed alone.
FREQUENT = 1 << 17
FREQUENT_PER_CHUNK = 20_000
OFTEN_IN_CHUNK = 4
CHUNK_SHINGLES = 1 << 21
# Nodes of a block of a tile.
BLOCK = 1024
# Bits of a signature per shingle, at least: of all nodes, and of those in tiles that stay open.
NARROW, WIDE = 2, 8
# Partners of a node that are compared before all others.
BEST = 2
CACHED_WORDS = 200_000
SEEN_TILES = 1 << 19
FILTER_BITS = 1 << 20


class WordHashes(dict):
    """64-bit hashes of words, kept up to a bound."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_HASHES = WordHashes()
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return h ^ (h >> np.uint64(29))


def shingles(text: str | None) -> np.ndarray:
    """The sorted distinct 64-bit hashes of a text's shingles.

    A-Z are lower-cased; a text of fewer than ``WORDS`` words is one shingle, an empty one has none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_HASHES.__getitem__, words), np.uint64, n)
    width = min(n, WORDS)
    # The number of words starts the hash, so that short texts differ from shingles.
    h = np.full(n - width + 1, width, np.uint64)
    for k in range(width):
        h = mixed(h ^ hashes[k : n - width + 1 + k])
    return np.unique(h)


def node_of(tokens: np.ndarray) -> int:
    """A set's 64-bit name. Sets of equal name are taken for equal: of a billion sets, 0.03 pairs."""
    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def width_of(n: int, bits: int = NARROW) -> int:
    """Bits of the signature of a set: a power of two, up to a bound. Sets of one band share it."""
    return min(max(128, 1 << (bits * n - 1).bit_length()), 1 << 18)


def signature(tokens: np.ndarray, bits: int = NARROW) -> bytes:
    flags = np.zeros(width_of(len(tokens), bits), bool)
    flags[(tokens >> np.uint64(20)).astype(np.int64) & (len(flags) - 1)] = True
    return np.packbits(flags, bitorder="little").tobytes()


def folded(bits: np.ndarray, words: int) -> np.ndarray:
    """A signature of 64-bit words at a smaller width (both are powers of two)."""
    return bits if len(bits) == words else np.bitwise_or.reduce(bits.reshape(-1, words), axis=0)


def enough(overlap, n, m):
    """Whether an overlap makes two sets of sizes ``n`` and ``m`` link."""
    return 100 * overlap >= PERCENT * (n + m - overlap)


def may_link(n: int, m: int, a: np.ndarray, b: np.ndarray) -> bool:
    """Whether sizes and bitmaps allow a link.

    A set bit of one side that the other lacks stands for at least one shingle that isn't shared.
    """
    if 100 * min(n, m) < PERCENT * max(n, m):
        return False
    words = min(len(a), len(b))
    a, b = folded(a, words), folded(b, words)
    only_a = int(np.bitwise_count(a & ~b).sum())
    only_b = int(np.bitwise_count(b & ~a).sum())
    return enough(min(n - only_a, m - only_b), n, m)


def prefix_size(n: int) -> int:
    return n - -(-PERCENT * n // 100) + 1


def _measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row per text: size, name, signature. And rows of shingles that are frequent here."""
    held: list[np.ndarray] = []
    size = 0

    def frequent() -> pa.RecordBatch:
        tokens, counts = np.unique(np.concatenate(held), return_counts=True) if held else (np.empty(0, np.uint64), np.empty(0, int))
        often = counts >= OFTEN_IN_CHUNK
        tokens, counts = tokens[often], counts[often]
        top = np.argsort(-counts, kind="stable")[:FREQUENT_PER_CHUNK]
        return _rows([None], [None], [None], [None], [None], [tokens[top].view(np.int64)], [counts[top]])

    for batch in batches:
        docs, keys = batch.column(0), batch.column(1)
        n, nodes, bits = [], [], []
        for text in batch.column(2):
            tokens = shingles(text.as_py())
            n.append(len(tokens))
            nodes.append(node_of(tokens) if len(tokens) else None)
            bits.append(signature(tokens) if len(tokens) else None)
            held.append(tokens)
            size += len(tokens)
            if size >= CHUNK_SHINGLES:
                yield frequent()
                held, size = [], 0
        yield _rows(docs, keys, n, nodes, bits, [None] * len(n), [None] * len(n))
    if held:
        yield frequent()


MEASURED = "doc_id long, key long, n long, node long, bits binary, tokens array<long>, counts array<long>"


def _rows(docs, keys, n, nodes, bits, tokens, counts) -> pa.RecordBatch:
    long, many = pa.int64(), pa.list_(pa.int64())
    kinds = {"doc_id": long, "key": long, "n": long, "node": long, "bits": pa.binary(), "tokens": many, "counts": many}
    columns = [x if isinstance(x, pa.Array) else pa.array(x, k) for x, k in zip((docs, keys, n, nodes, bits, tokens, counts), kinds.values())]
    return pa.RecordBatch.from_arrays(columns, list(kinds))


def _prefixes(frequent: np.ndarray, ranks: np.ndarray):
    """Per text: name, size, and the first shingles of its set; frequent ones come last, by rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes, sizes, firsts = [], [], []
            for text in batch.column(0):
                tokens = shingles(text.as_py())
                n = len(tokens)
                if not n:
                    continue
                p = prefix_size(n)
                at = np.searchsorted(frequent, tokens)
                at[at == len(frequent)] = 0
                often = frequent[at] == tokens if len(frequent) else np.zeros(n, bool)
                first = tokens[~often][:p]
                if len(first) < p:
                    rest = tokens[often][np.argsort(ranks[at[often]], kind="stable")]
                    first = np.concatenate([first, rest[: p - len(first)]])
                nodes.append(node_of(tokens))
                sizes.append(n)
                firsts.append(first.view(np.int64))
            long = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [pa.array(nodes, long), pa.array(sizes, long), pa.array(firsts, pa.list_(long))], ["node", "n", "first"]
            )

    return run


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles of a partition of postings that is sorted by shingle, size and node.

    A tile is a row per block of its nodes. Of equal tiles, most are written once. Only the current
    shingle's nodes are held, and written as soon as a block is full. Further columns of numbers, which
    follow from the node, become further arrays.
    """
    seen: set[int] = set()
    out: list[tuple] = []
    names: list[str] = []
    token = None
    rows: list[tuple[np.ndarray, ...]] = []  # nodes, sizes and further columns
    held = blocks = 0

    def block(final: bool) -> None:
        nonlocal rows, held, blocks
        if not held or (final and not blocks and held < 2):
            return
        every = [np.concatenate(column) for column in zip(*rows)]
        for low in range(0, held, BLOCK):
            part = tuple(column[low : low + BLOCK] for column in every)
            if not final and len(part[0]) < BLOCK:
                rows, held = [part], len(part[0])
                return
            # One short tile has one row, named by its nodes; a long one is named by its shingle.
            one = final and not blocks and len(every[0]) <= BLOCK
            name_ = xxhash.xxh3_64_intdigest(part[0].tobytes()) if one else xxhash.xxh3_64_intdigest(f"long {token}")
            if one and name_ in seen:
                continue
            if one:
                if len(seen) >= SEEN_TILES:
                    seen.clear()
                seen.add(name_)
            out.append((name_ - (1 << 63), blocks, *part))
            blocks += 1
        rows, held = [], 0

    def batch_out() -> pa.RecordBatch:
        tile, number, *arrays = zip(*out)
        made = pa.RecordBatch.from_arrays(
            [pa.array(tile, pa.int64()), pa.array(number, pa.int32()), *(pa.array(x, pa.list_(pa.int64())) for x in arrays)],
            ["tile", "block", "nodes", "sizes", *names],
        )
        out.clear()
        return made

    for batch in batches:
        tokens, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
        names = batch.schema.names[3:]
        if not len(tokens):
            continue
        cuts = np.flatnonzero(tokens[1:] != tokens[:-1]) + 1
        starts, ends = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(tokens)]])
        # A run of one node is no tile, but at a batch's edges it may go on.
        keep = (ends - starts > 1) | (starts == 0) | (ends == len(tokens))
        for a, b in zip(starts[keep].tolist(), ends[keep].tolist()):
            if token is None or tokens[a] != token:
                block(True)
                token, blocks = tokens[a], 0
                rows, held = [], 0
            rows.append(tuple(c[a:b] for c in columns))
            held += b - a
            if held >= 2 * BLOCK:
                block(False)
        if len(out) >= 1000:
            yield batch_out()
    block(True)
    if out:
        yield batch_out()


def _near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node of a block with the smallest one of a compatible size, and with the one before it."""
    for batch in batches:
        found: list[np.ndarray] = []
        for nodes, sizes in zip(batch.column(0), batch.column(1)):
            ids, n = nodes.values.to_numpy(), sizes.values.to_numpy()
            first = np.searchsorted(n, -(-PERCENT * n // 100))
            at = np.arange(len(n))
            far = first < at
            found.append(np.stack([ids[first[far]], ids[at[far]]], axis=1))
            next_ = 100 * n[:-1] >= PERCENT * n[1:]
            found.append(np.stack([ids[:-1][next_], ids[1:][next_]], axis=1))
        pairs = np.concatenate(found) if found else np.empty((0, 2), np.int64)
        pairs = np.unique(np.sort(pairs, axis=1), axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs whose sizes and bitmaps allow a link."""
    for batch in batches:
        a, b, n, m, x, y = (batch.column(k) for k in range(6))
        good = [
            may_link(i, j, np.frombuffer(p, np.uint64), np.frombuffer(q, np.uint64))
            for i, j, p, q in zip(n.to_pylist(), m.to_pylist(), x.to_pylist(), y.to_pylist())
        ]
        yield pa.RecordBatch.from_arrays([a, b], ["a", "b"]).filter(pa.array(good, pa.bool_()))


def _exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The pairs of texts whose sets link, by intersecting sorted arrays."""
    held: dict[int, np.ndarray] = {}

    def of(node: int, text: str) -> np.ndarray:
        if node not in held:
            if len(held) >= 64:
                held.clear()
            held[node] = shingles(text)
        return held[node]

    for batch in batches:
        good = []
        for a, b, x, y in zip(*(batch.column(k) for k in range(4))):
            p, q = of(a.as_py(), x.as_py()), of(b.as_py(), y.as_py())
            both = len(np.intersect1d(p, q, assume_unique=True))
            good.append(enough(both, len(p), len(q)))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(good, pa.bool_()))


class Side:
    """A block's nodes as arrays, its signatures stacked by width."""

    def __init__(self, rows: pa.Array):
        items = rows.flatten()
        self.node, self.n, self.label = (items[k].to_numpy() for k in range(3))
        bits = [np.frombuffer(x, np.uint64) for x in items[3].to_pylist()]
        self.bits = bits
        widths = np.array([len(x) for x in bits])
        self.stacks = {int(w): (np.flatnonzero(widths == w), np.stack([bits[i] for i in np.flatnonzero(widths == w)])) for w in np.unique(widths)}

    def overlaps(self, bits: np.ndarray, n: int) -> np.ndarray:
        """Bounds of the overlap of one more set with each of these."""
        out = np.empty(len(self.node), np.int64)
        for width, (at, stack) in self.stacks.items():
            words = min(width, len(bits))
            one = folded(bits, words)
            many = stack if width == words else np.bitwise_or.reduce(stack.reshape(len(at), -1, words), axis=1)
            only_one = np.bitwise_count(one & ~many).sum(axis=1)
            only_many = np.bitwise_count(many & ~one).sum(axis=1)
            out[at] = np.minimum(n - only_one.astype(np.int64), self.n[at] - only_many.astype(np.int64))
        return out


def _blocks(best: int | None):
    """Pairs of one tile's nodes of different components that sizes and bitmaps allow, from two blocks.

    With ``best``, of each node only so many, those whose bounds are the highest.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for k in range(batch.num_rows):
                left = Side(batch.column(0)[k].values)
                right = Side(batch.column(1)[k].values) if batch.column(1)[k].is_valid else None
                found = [_partners(left, i, right, best) for i in range(len(left.node))]
                pairs = np.concatenate(found)
                if len(pairs):
                    pairs = np.unique(np.sort(pairs, axis=1), axis=0)
                    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def _suspects(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes of two blocks that have a partner of another component as far as bitmaps tell."""
    for batch in rows:
        for k in range(batch.num_rows):
            left = Side(batch.column(0)[k].values)
            right = Side(batch.column(1)[k].values) if batch.column(1)[k].is_valid else None
            found = [_partners(left, i, right, None) for i in range(len(left.node))]
            nodes = np.unique(np.concatenate(found))
            if len(nodes):
                yield pa.RecordBatch.from_arrays([pa.array(nodes)], ["node"])


def _partners(left: Side, i: int, right: Side | None, best: int | None) -> np.ndarray:
    """Pairs of node ``i`` of a block with nodes of another block, or with later ones of its own."""
    other = left if right is None else right
    n, m = int(left.n[i]), other.n
    good = (other.label != left.label[i]) & (100 * np.minimum(n, m) >= PERCENT * np.maximum(n, m))
    if right is None and best is None:
        good[: i + 1] = False
    if good.any():
        overlap = other.overlaps(left.bits[i], n)
        good &= enough(overlap, n, m)
        if best is not None and good.sum() > best:
            likeness = np.where(good, overlap / (n + m - overlap), -1.0)
            good = np.zeros(len(m), bool)
            good[np.argpartition(-likeness, best)[:best]] = True
    b = other.node[good]
    return np.stack([np.full(len(b), left.node[i]), b], axis=1)


PAIR = "a long, b long"


def key_of(docs: DataFrame, text: str = "text") -> Column:
    return F.xxhash64(name("doc_id").cast("long"), text_of(docs, text))


class Join:
    """One run over ``docs``: sets, tiles, links and components."""

    def __init__(self, docs: DataFrame, text: str = "text"):
        self.docs = docs.select(
            name("doc_id").cast("long").alias("doc_id"), key_of(docs, text).alias("key"), text_of(docs, text).alias("text")
        )
        self.measured = durable(self.docs.mapInArrow(_measure, MEASURED))
        self.sets = self.measured.filter(F.col("n").isNotNull()).select("doc_id", "key", "n", "node", "bits")
        some = self.sets.filter(F.col("n") > 0)
        # One row per node, made before the shuffle as far as copies meet there.
        self.nodes = durable(some.groupBy("node").agg(F.min("key").alias("key"), F.first("n").alias("n"), F.first("bits").alias("bits")))

    def frequent(self) -> tuple[np.ndarray, np.ndarray]:
        """The most frequent shingles (at most ``FREQUENT``), sorted, and their ranks from rare to frequent."""
        each = self.measured.filter(F.col("n").isNull()).select(F.explode(F.arrays_zip("tokens", "counts")).alias("x"))
        sums = each.groupBy(F.col("x.tokens").alias("token")).agg(F.sum("x.counts").alias("n"))
        found = sums.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()
        tokens = found.column("token").to_numpy().view(np.uint64)
        order = np.argsort(tokens, kind="stable")
        ranks = np.arange(len(tokens))[::-1]
        return tokens[order], ranks[order]

    def tiles(self) -> DataFrame:
        frequent, ranks = self.frequent()
        firsts = self.docs.select("text").mapInArrow(_prefixes(frequent, ranks), "node long, n long, first array<long>")
        once = firsts.groupBy("node").agg(F.first("n").alias("n"), F.first("first").alias("first"))
        postings = once.select(F.explode("first").alias("token"), "node", "n")
        ranged = postings.repartition("token").sortWithinPartitions("token", "n", "node")
        made = ranged.mapInArrow(_tiles, "tile long, block int, nodes array<long>, sizes array<long>")
        return durable(made.dropDuplicates(["tile", "block"]))

    def bounded(self, pairs: DataFrame) -> DataFrame:
        side = lambda k, n, bits: self.nodes.select(F.col("node").alias(k), F.col("n").alias(n), F.col("bits").alias(bits))
        both = pairs.join(side("a", "n", "x"), "a").join(side("b", "m", "y"), "b")
        return durable(both.select("a", "b", "n", "m", "x", "y").mapInArrow(_bounded, PAIR))

    def texts_of(self, asked: DataFrame) -> DataFrame:
        """One text for each of the nodes asked for (``node``).

        A bitmap of hashed keys, of a fixed size, keeps most other texts out of the shuffle.
        """
        wanted = durable(asked.select("node").distinct().join(self.nodes.select("node", "key"), "node"))
        place = F.pmod("key", F.lit(FILTER_BITS)) + 1
        maps = (
            wanted.groupBy(F.bitmap_bucket_number(place).alias("part"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("map"))
            .collect()
        )
        flags = np.zeros(FILTER_BITS, bool)
        for row in maps:
            bits = np.unpackbits(np.frombuffer(row["map"], np.uint8), bitorder="little")
            flags[(row["part"] - 1) * len(bits) : row["part"] * len(bits)] = bits
        shared = self.docs.sparkSession.sparkContext.broadcast(np.packbits(flags))

        def likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = np.unpackbits(shared.value).astype(bool)
            for batch in batches:
                keys = batch.column(0).to_numpy()
                yield batch.filter(pa.array(known[keys % FILTER_BITS]))

        texts = self.docs.select("key", "text").mapInArrow(likely, "key long, text string")
        return texts.join(wanted, "key").dropDuplicates(["node"]).select("node", "text")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The pairs that link."""
        texts = self.texts_of(pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))))
        first = pairs.join(texts.select(F.col("node").alias("a"), F.col("text").alias("x")), "a")
        both = first.join(texts.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")
        return durable(both.select("a", "b", "x", "y").mapInArrow(_exact, PAIR))

    def open_members(self, tiles: DataFrame, labels: DataFrame) -> DataFrame:
        """Nodes of tiles that hold several components: ``tile``, ``block``, ``blocks``, ``node``, ``n``, ``label``.

        Of three nodes, comparing each with the first compatible one and the one before has compared all
        pairs, so only larger tiles are left.
        """
        each = tiles.select("tile", "block", F.posexplode("nodes").alias("at", "node"), "sizes").select(
            "tile", "block", "node", F.get("sizes", F.col("at")).alias("n")
        )
        known = each.join(labels.withColumnRenamed("component", "label"), "node", "left").withColumn(
            "label", F.coalesce("label", "node")
        )
        held = known.groupBy("tile").agg(
            F.min("label").alias("low"),
            F.max("label").alias("high"),
            F.count(F.lit(1)).alias("size"),
            (F.max("block") + 1).alias("blocks"),
        )
        held = held.filter((F.col("low") != F.col("high")) & (F.col("size") > 3)).select("tile", "blocks")
        return durable(known.join(held, "tile"))

    def wide(self, members: DataFrame) -> DataFrame:
        """Wide signatures of the nodes: ``node``, ``bits``."""

        def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                bits = [signature(shingles(text.as_py()), WIDE) for text in batch.column(1)]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bits, pa.binary())], ["node", "bits"])

        return durable(self.texts_of(members).mapInArrow(sign, "node long, bits binary"))

    def meetings(self, members: DataFrame, bits: DataFrame) -> DataFrame:
        """Blocks of open tiles with themselves (``other`` is null) and with later ones, as arrays of nodes."""
        rows = members.join(bits, "node").groupBy("tile", "block", "blocks").agg(
            F.min("n").alias("low"),
            F.max("n").alias("high"),
            F.collect_list(F.struct("node", "n", "label", "bits")).alias("rows"),
        )
        inside = rows.select("rows", F.lit(None).cast(rows.schema["rows"].dataType).alias("other"))
        # Few tiles have several blocks; these are in order of size, so only near ones are compatible.
        many = rows.filter(F.col("blocks") > 1)
        left = many.select("tile", F.col("block").alias("i"), F.col("high").alias("top"), "rows")
        right = many.select("tile", F.col("block").alias("j"), F.col("low").alias("bottom"), F.col("rows").alias("other"))
        meet = (F.col("i") < F.col("j")) & (F.col("top") * 100 >= F.col("bottom") * PERCENT)
        return inside.unionByName(left.join(right, "tile").filter(meet).select("rows", "other"))

    def suspects(self, members: DataFrame) -> DataFrame:
        """The members that may link to another component by their narrow signatures; most can't."""
        found = self.meetings(members, self.nodes.select("node", "bits")).mapInArrow(_suspects, "node long")
        return durable(members.join(found.distinct(), "node", "left_semi"))

    def open_pairs(self, members: DataFrame, wide: DataFrame, best: int | None) -> DataFrame:
        """Pairs of different components in tiles that aren't settled, block by block."""
        return durable(self.meetings(members, wide).mapInArrow(_blocks(best), PAIR).distinct())

    def labels(self) -> DataFrame:
        """Components of linked nodes: ``node``, ``component``."""
        tiles = self.tiles()
        near = tiles.select("nodes", "sizes").mapInArrow(_near_pairs, PAIR).distinct()
        links = self.verified(self.bounded(near))
        known = durable(components(links))
        members = self.suspects(self.open_members(tiles, known))
        wide = self.wide(members)
        # All pairs that the last of these leaves out are in one component or can't link.
        for best in (BEST, None):
            more = self.open_pairs(members, wide, best)
            if more.isEmpty():
                return known
            links = links.unionByName(self.verified(more))
            known = durable(components(links))
            relabelled = members.drop("label").join(known.withColumnRenamed("component", "label"), "node", "left")
            relabelled = relabelled.withColumn("label", F.coalesce("label", "node"))
            held = relabelled.groupBy("tile").agg(F.min("label").alias("low"), F.max("label").alias("high"))
            # Tiles that are settled by now take no part in the next round.
            members = durable(relabelled.join(held.filter(F.col("low") != F.col("high")).select("tile"), "tile"))
        return known

    def result(self) -> DataFrame:
        """Per document: ``doc_id``, ``key``, ``n``, ``component`` (of nodes) and ``component_id``."""
        labels = self.labels()
        grouped = self.sets.filter(F.col("n") > 0).groupBy("node").agg(F.min("doc_id").alias("least"))
        named = grouped.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node"))
        named = durable(named)
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        of_node = named.select("node", "component").join(least, "component")
        return self.sets.drop("bits").join(of_node, "node", "left").select(
            "doc_id",
            "key",
            F.col("n").alias("n_shingles"),
            "component",
            F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        )


def link(docs: DataFrame, text: str = "text") -> DataFrame:
    """Per document: ``doc_id``, ``n_shingles`` and ``component_id``, the smallest id reachable by links.

    Equal sets link, whatever their number; an empty text (or null) has no shingles and links with
    nothing, so it is its own component. A row without id takes part and has the smallest id of its
    component, null if that has none; rows that share an id are documents of their own. Very long texts
    have large sets, which wide bitmaps bound less well. An empty table gives an empty one.
    """
    return Join(docs, text).result().select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, text: str = "text") -> DataFrame:
    """One document of each component, with all its columns: the one with the smallest id (null last).

    Of rows that are equal in id and text one stays. Documents without words all stay.
    """
    found = Join(docs, text).result()
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key")
    best = found.filter(F.col("n_shingles") > 0).groupBy("component").agg(F.min(order).alias("best"))
    kept = best.select(F.col("best.key").alias("_key"))
    empty = found.filter(F.col("n_shingles") == 0).select(F.col("key").alias("_key")).distinct()
    rows = docs.select(key_of(docs, text).alias("_key"), packed(docs).alias("_row"))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("_key"))
    one = rows.join(kept.distinct(), "_key", "left_semi").withColumn("_turn", first).filter(F.col("_turn") == 1)
    both = one.select("_row").unionByName(rows.join(empty, "_key", "left_semi").select("_row"))
    return unpacked(both, "_row", docs.columns)
