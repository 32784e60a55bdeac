"""Similarity joins that find every pair at or above a threshold without comparing all pairs.

Keys are distinct texts ``(id, key)``. Equal texts are one key, so a value that fills a third of
a table is a single row here; ``operators.groups`` brings its copies back.

Edit distance: cut the shorter of two keys within ``d`` edits into ``d + n`` disjoint chunks or more,
and ``n`` of them at least are untouched and occur in the longer one, moved by at most ``d`` places.
One untouched chunk (``n = 1``) is joined by plain equality of its text and place. Where chunks are so
common that this gives many candidates, two untouched chunks (``n = 2``) are joined together: of ``d + 2``
chunks one can always choose two such that the edits before, between and after them are no more than the
chosen chunks there, which leaves few places for both. Candidates then follow the square of a chunk's
frequency, so they grow no faster than the matches until a table outgrows the chunks by far. Chunks that
a sixty-fourth of all keys share count for nothing there; keys without enough other chunks stay on the
first path.

Word overlap: let two word sets with overlap ``t`` be ordered from rare to common. They share one of the
first ``n - ceil(t n) + 1`` words of the larger and ``n - ceil(2 t n / (1 + t)) + 1`` of the smaller set.

A combined similarity has a bound between the two: pairs with a word overlap of ``j`` or more come from
the word join, all others need the more edit similarity and come from the chunk join; ``j`` is chosen by
the measured cost of the word join. All filters only drop pairs that cannot qualify; the exact formula
decides.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscour.functions.similarity import blend, overlap, words
from sparkscour.operators.components import components
from sparkscour.session import KEY_BUCKETS, durable, join_hot, key_bucket, salted_join, salts_of, unsent

MARGIN = 1e-9
MAX_GRAM = 8
CHUNK_CHOICES = (0, 1, 2)
# A rank has a level in front and these bits of the hash behind it.
HASH_BITS = 55
# 64-bit numbers of a word set's bitmap, which bounds what two sets can share.
BITMAP_LONGS = 8
STRATEGIES = ("levenshtein", "jaccard", "combined")
# Postings of one gram or word that are compared by one task.
HOT_POSTINGS = 20_000
# Keys and items (words) of a part of a component; a task that verifies pairs holds two parts.
TILE_KEYS = 2048
TILE_ITEMS = 1 << 22
# Pairs whose items are looked at together.
PAIRS_AT_ONCE = 256
# A chunk is common if more than one in so many keys, and at least so many keys, have it.
COMMON_SHARE = 64
COMMON_LEAST = 64
# Fewer keys than this meet by single chunks at little cost, however common these are.
LEAST_PAIRED = 1000
# What a candidate costs, in postings: it is filtered, made distinct and often verified.
CANDIDATE_COST = 8
# Word overlaps that may bound the word join of a combined similarity, and the word matches that a
# key may have there on average before a higher one is taken.
OVERLAP_CHOICES = (0.2, 0.35, 0.5, 0.61, 0.75, 0.9, 1.0)
WORD_MATCHES = 32


def _level_of(n: float) -> int:
    """Three levels per doubling of a count."""
    return min(127, int(3 * math.log2(n + 1)))


class Commonness:
    """How common chunks or words are, as counts per hash bucket.

    It has ``KEY_BUCKETS`` numbers whatever the data. They go to the tasks with a function on arrays of
    hashes; as a constant, the plan and each of its descriptions on the driver would hold them as often as
    it names them. It decides what is indexed first and what is salted, never what is compared.
    """

    def __init__(self, counts: dict[int, int], shorter: int = 0, needed: int = 1, keys: int = 0) -> None:
        self.shorter = shorter
        self.needed = needed
        self.keys = keys
        self.salts = salts_of(counts, HOT_POSTINGS)
        self.common_level = _level_of(max(COMMON_LEAST, keys / COMMON_SHARE))
        self._levels = np.zeros(KEY_BUCKETS, np.uint8)
        for bucket, n in counts.items():
            self._levels[bucket] = _level_of(n)
        # Few: each has about a sixty-fourth of all keys.
        self._common = np.flatnonzero(self._levels > self.common_level).tolist()

    @classmethod
    def of(cls, items: DataFrame) -> Commonness:
        """Measure a table with one hashed ``item`` per row."""
        counted = items.groupBy(key_bucket(F.col("item")).alias("bucket")).count().toArrow()
        return cls(dict(zip(counted["bucket"].to_pylist(), counted["count"].to_pylist())))

    def rare(self, item: Column) -> Column:
        return ~key_bucket(item).isin(self._common) if self._common else item.isNotNull()

    def ranked(self, items: Column) -> Column:
        """An array of hashes with their levels in front, so that numbers sort from rare to common."""
        levels, buckets, bits = self._levels, KEY_BUCKETS, HASH_BITS

        @F.arrow_udf("array<bigint>")
        def rank(arrays: pa.Array) -> pa.Array:
            hashes = arrays.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            level = levels[hashes % buckets].astype(np.int64)
            sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            values = pa.array((level << bits) | (hashes & ((1 << bits) - 1)), pa.int64())
            return pa.ListArray.from_arrays(pa.array(offsets), values)

        # So that no filter that Spark derives runs it again.
        return rank.asNondeterministic()(items)

    def join(self, many: DataFrame, one: DataFrame, spread_by: Column) -> DataFrame:
        bucket = key_bucket(F.col("gram"))
        return salted_join(many, one, ["gram"], "inner", bucket, self.salts, spread_by)


def rank_level(rank: Column) -> Column:
    return F.shiftright(rank, HASH_BITS)


def rank_count(rank: Column) -> Column:
    """About how many items share the bucket of a ranked hash."""
    return F.pow(F.lit(2.0), rank_level(rank) / 3)


@dataclass
class JoinPlan:
    """How pairs are found: what was measured once, good for subsets of the keys too.

    ``overlap`` bounds the word join (None: there is none), ``share`` is the edit similarity that pairs
    below that overlap need (above 1: there are none), joined by ``single`` chunks or two of ``paired``.
    """

    words: Commonness | None = None
    overlap: float | None = None
    share: float = 2.0
    single: Commonness | None = None
    paired: Commonness | None = None


def require_threshold(threshold: float | None) -> float:
    t = 0.85 if threshold is None else float(threshold)
    if not 0 < t <= 1:
        raise ValueError("the similarity threshold must be above 0 and at most 1")
    return t


def distinct_keys(rows: DataFrame, key: str = "comparison_value", row_id: str = "row_id") -> DataFrame:
    """One row per distinct non-empty key: the smallest row id and the number of rows."""
    return (
        rows.filter(F.col(key) != "")
        .groupBy(F.col(key).alias("key"))
        .agg(F.min(row_id).alias("id"), F.count(F.lit(1)).alias("copies"))
    )


def edit_share(strategy: str, t: float) -> float:
    """The edit similarity that a pair needs at least."""
    return (t - 0.3) / 0.7 if strategy == "combined" else t


def word_share(strategy: str, t: float) -> float:
    """The word overlap that a pair needs at least; none where it is not above 0."""
    if strategy == "jaccard":
        return t
    return (t - 0.7) / 0.3 if strategy == "combined" else 0.0


def _most_edits(longest: Column, t: float) -> Column:
    return F.floor(longest * F.lit(1 - t) + MARGIN).cast("int")


def _most_edits_of_shorter(length: Column, t: float) -> Column:
    """Edits allowed against the longest partner that a key of this length can have."""
    return F.floor(length * F.lit((1 - t) / t) + MARGIN).cast("int")


def _shortest_partner(length: Column, t: float) -> Column:
    return F.greatest(F.ceil(length * F.lit(t) - MARGIN).cast("int"), F.lit(1))


def _chunks_needed(length: Column, t: float, common: Commonness) -> Column:
    return _most_edits_of_shorter(length, t) + common.needed


def _gram_size(length: Column, t: float, common: Commonness) -> Column:
    """Chunk length: the longest that leaves enough chunks, or ``shorter`` less, down to 3.

    Shorter chunks are more common in general, but give more chunks to choose rare ones from. It is 0
    for a key of fewer characters than chunks.
    """
    whole = F.floor(length / _chunks_needed(length, t, common)).cast("int")
    size = F.greatest(whole - common.shorter, F.least(whole, F.lit(3))) if common.shorter else whole
    return F.least(size, F.lit(MAX_GRAM))


# Edit distance


def _chunk_hashes(key: Column, length: Column, size: Column) -> Column:
    # A chunk moves by few places, so its own place is part of what must be equal.
    last = F.floor(length / F.greatest(size, F.lit(1))).cast("int") - 1
    hashes = F.transform(
        F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.substring(key, i * size + 1, size), i)
    )
    return F.when(size > 0, hashes).otherwise(F.array().cast("array<bigint>"))


def _picked_chunks(hashes: Column, length: Column, t: float, common: Commonness) -> Column:
    """The rarest chunks of a key with these ``hashes``, as many as are needed, in rank order."""
    both = F.arrays_zip(common.ranked(hashes).alias("rank"), hashes.alias("item"))
    placed = F.transform(
        both, lambda c, i: F.struct(c["rank"].alias("rank"), c["item"].alias("item"), i.alias("at"))
    )
    return F.slice(F.sort_array(placed), F.lit(1), _chunks_needed(length, t, common))


def _picked(keys: DataFrame, t: float, common: Commonness) -> DataFrame:
    length = F.length("key")
    size = _gram_size(length, t, common)
    hashed = keys.select(
        "id", "key", length.alias("len"), size.alias("size"), _chunk_hashes(F.col("key"), length, size).alias("hashes")
    )
    # Ids and places are joined; texts are fetched for the pairs that meet.
    return hashed.select("id", "key", "len", "size", _picked_chunks(F.col("hashes"), F.col("len"), t, common).alias("picked"))


def _chunks(keys: DataFrame, t: float, common: Commonness) -> DataFrame:
    """The shorter side: its rarest chunks, one more than the edits it can take."""
    return _picked(keys, t, common).select("id", "len", "size", F.inline("picked")).select(
        F.col("item").alias("gram"),
        F.col("id").alias("s_id"),
        F.col("len").alias("s_len"),
        (F.col("at") * F.col("size")).alias("s_pos"),
    )


def _sized(keys: DataFrame, t: float, common: Commonness) -> DataFrame:
    """Each key with the chunk sizes that shorter partners can have, and the partners' lengths."""
    sized = keys.select("id", "key", F.length("key").alias("len"))
    lengths = F.transform(
        F.sequence(_shortest_partner(F.col("len"), t), F.col("len")),
        lambda n: F.struct(_gram_size(n, t, common).alias("size"), n.alias("n")),
    )
    listed = sized.select("id", "key", "len", lengths.alias("lengths"))
    sizes = F.array_remove(F.array_distinct(F.col("lengths")["size"]), 0)
    each = listed.select("id", "key", "len", "lengths", F.explode(sizes).alias("size"))
    here = F.filter("lengths", lambda p: p["size"] == F.col("size"))["n"]
    return each.select(
        "id", "key", "len", "size", F.array_min(here).alias("shortest"), F.array_max(here).alias("longest")
    ).filter(F.col("size") <= F.col("len"))


def _grams(keys: DataFrame, t: float, common: Commonness) -> DataFrame:
    """The longer side: grams of each size that a partner's chunks can have, at places in reach."""
    spots = _sized(keys, t, common)
    places = F.sequence(F.lit(0), F.col("len") - F.col("size"))
    placed = spots.select("id", "key", "len", "size", F.explode(places).alias("at"))
    edits, at, size = _most_edits(F.col("len"), t), F.col("at"), F.col("size")
    first = F.greatest(F.ceil((at - edits) / size).cast("int"), F.lit(0))
    last = F.floor((at + edits) / size).cast("int")
    chunk = F.explode(F.when(first <= last, F.sequence(first, last))).alias("chunk")
    return placed.select("*", chunk).select(
        F.xxhash64(F.substring(F.col("key"), at + 1, size), F.col("chunk")).alias("gram"),
        F.col("id").alias("r_id"),
        F.col("len").alias("r_len"),
        at.alias("r_pos"),
    )


def _pairable(t: float, common: Commonness, picked: str = "picked") -> Column:
    """Whether a row of ``_picked`` has enough chunks that aren't common; the last is the most common."""
    last = F.get(picked, _chunks_needed(F.col("len"), t, common) - 1)["rank"]
    return F.coalesce(rank_level(last) <= common.common_level, F.lit(False))


def _chunk_pairs(picked: DataFrame) -> DataFrame:
    """The shorter side: every two of its picked chunks, as one gram."""
    placed = picked.select("id", "len", F.sort_array(F.transform("picked", lambda c: F.struct(c["at"], c["item"]))).alias("p"))
    first = placed.select("id", "len", "p", F.posexplode("p").alias("k", "one"))
    second = first.select("id", "len", "one", F.explode(F.slice("p", F.col("k") + 2, F.size("p"))).alias("two"))
    return second.select(
        F.xxhash64("one.item", "two.item").alias("gram"), F.col("id").alias("s_id"), F.col("len").alias("s_len")
    )


def _gram_pairs(keys: DataFrame, t: float, common: Commonness) -> DataFrame:
    """The longer side: two grams at places that two untouched chunks of a partner can have moved to.

    Edits before the first of them are at most the chunks there, likewise between and after them, and
    all three together at most ``d``. The lengths of partners say how far the end may have moved.
    """
    spots = _sized(keys, t, common)
    edits = _most_edits(F.col("len"), t)
    spots = spots.select(
        "id", "key", "len", "size", edits.alias("d"),
        (F.floor(F.col("longest") / F.col("size")).cast("int") - 1).alias("last"),
        (F.col("len") - F.col("longest")).alias("r_low"), (F.col("len") - F.col("shortest")).alias("r_high"),
    )

    def gram(chunk: Column, shift: Column) -> Column:
        return F.xxhash64(F.substring(F.col("key"), chunk * F.col("size") + shift + 1, F.col("size")), chunk)

    def inside(chunk: Column, shift: Column) -> Column:
        at = chunk * F.col("size") + shift
        return (at >= 0) & (at + F.col("size") <= F.col("len"))

    i1, s1, i2, s2, d = (F.col(c) for c in ("i1", "s1", "i2", "s2", "d"))
    one = spots.filter("last >= 1").select("*", F.explode(F.sequence(F.lit(0), F.col("last") - 1)).alias("i1"))
    reach = F.least(i1, d)
    one = one.select("*", F.explode(F.sequence(-reach, reach)).alias("s1")).filter(inside(i1, s1))
    one = one.withColumn("h1", gram(i1, s1)).filter(common.rare(F.col("h1")))
    two = one.select("*", F.explode(F.sequence(i1 + 1, F.col("last"))).alias("i2"))
    reach = F.least(i2 - i1 - 1, d - F.abs(s1))
    two = two.select("*", F.explode(F.sequence(s1 - reach, s1 + reach)).alias("s2"))
    rest = F.greatest(F.col("r_low") - s2, s2 - F.col("r_high"), F.lit(0))
    two = two.filter(
        inside(i2, s2) & (rest <= F.col("last") - i2) & (F.abs(s1) + F.abs(s2 - s1) + rest <= d)
    )
    two = two.withColumn("h2", gram(i2, s2)).filter(common.rare(F.col("h2")))
    return two.select(
        F.xxhash64("h1", "h2").alias("gram"), F.col("id").alias("r_id"), F.col("len").alias("r_len"),
        s1.cast("short").alias("s1"), s2.cast("short").alias("s2"),
    )


def _lengths_in_reach(short: DataFrame, long: DataFrame, t: float) -> DataFrame:
    """Every pair whose lengths allow a match, as an equality join on the shorter length."""
    length = F.length("key")
    reach = F.lit(1) if t <= 0 else _shortest_partner(length, t)
    left = short.select(
        length.alias("gram"), F.col("id").alias("s_id"), length.alias("s_len"), F.lit(0).alias("s_pos"),
    )
    right = long.select(
        F.explode(F.sequence(reach, length)).alias("gram"), F.col("id").alias("r_id"),
        length.alias("r_len"), F.lit(0).alias("r_pos"),
    )
    return join_hot(
        left, right, "gram", spread_by=F.col("s_id"), hot_rows=HOT_POSTINGS
    )


def _chunk_candidates(
    short: DataFrame, long: DataFrame, plan: JoinPlan, same_length: Column
) -> DataFrame:
    """Distinct ``(s_id, r_id)``: a key of ``short`` and an at least as long key of ``long``."""
    share = plan.share
    edits = _most_edits(F.col("r_len"), share) if share > 0 else F.col("r_len")
    surplus = F.col("r_len") - F.col("s_len")
    sides = (F.col("s_id") != F.col("r_id")) & ((surplus > 0) | ((surplus == 0) & same_length)) & (surplus <= edits)
    if share <= 0.5:
        return _lengths_in_reach(short, long, share).filter(sides).select("s_id", "r_id").distinct()
    found = []
    if plan.paired is not None:
        # Read for those that are able, those that aren't, and the question if there are any.
        picked = durable(_picked(short, share, plan.paired))
        able = _pairable(share, plan.paired)
        met = join_hot(
            _chunk_pairs(picked.filter(able)), _gram_pairs(long, share, plan.paired), "gram",
            spread_by=F.col("s_id"), hot_rows=HOT_POSTINGS,
        )
        moved = F.abs("s1") + F.abs(F.col("s2") - F.col("s1")) + F.abs(surplus - F.col("s2"))
        found.append(met.filter(sides & (moved <= edits)).select("s_id", "r_id"))
        short = durable(picked.filter(~able).select("id", "key"))
    if plan.paired is None or not short.isEmpty():
        met = plan.single.join(_chunks(short, share, plan.single), _grams(long, share, plan.single), F.col("s_id"))
        shift = F.col("r_pos") - F.col("s_pos")
        close = met.filter(sides & (F.abs(shift) + F.abs(surplus - shift) <= edits))
        found.append(close.select("s_id", "r_id"))
    # A pair that shares several chunks is verified once.
    return reduce(DataFrame.unionByName, found).distinct()


# Word overlap


def _first_words(n: Column, t: float, smaller: bool) -> Column:
    """How many of the rarest words of a set must hold one that it shares with a larger or smaller one."""
    share = 2 * t / (1 + t) if smaller else t
    return n - F.ceil(n * F.lit(share) - MARGIN).cast("int") + 1


def _ranked_words(common: Commonness) -> Column:
    return F.sort_array(common.ranked(F.transform(words("key"), lambda w: F.xxhash64(w))))


def _bitmap(ranked: Column) -> Column:
    """A bitmap of the hashes of an array, as ``BITMAP_LONGS`` numbers."""
    width = BITMAP_LONGS

    @F.arrow_udf("array<bigint>")
    def mapped(arrays: pa.Array) -> pa.Array:
        place = (arrays.flatten().to_numpy(zero_copy_only=False) >> 16) & (64 * width - 1)
        sizes = arrays.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        flags = np.zeros((len(sizes), 64 * width), bool)
        flags[np.repeat(np.arange(len(sizes)), sizes), place] = True
        bits = np.packbits(flags, axis=1, bitorder="little").view(np.int64).ravel()
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1, dtype=np.int32) * width), pa.array(bits, pa.int64()))

    return mapped.asNondeterministic()(ranked)


def _lacking(a: str, b: str) -> Column:
    """Bits of a bitmap that another lacks: each stands for at least one word that isn't shared."""
    return reduce(
        Column.__add__,
        [F.bit_count(F.get(a, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(b, F.lit(i))))) for i in range(BITMAP_LONGS)],
    )


def _postings(keys: DataFrame, t: float, common: Commonness, side: str, mapped: bool = False) -> DataFrame:
    """The first words of each set, with their places; side ``s`` is the smaller set. ``mapped``: with bitmaps."""
    listed = keys.select("id", F.length("key").alias("len"), _ranked_words(common).alias("ranked"))
    kept = ["id", "len", "map"] if mapped else ["id", "len"]
    if mapped:
        listed = listed.withColumn("map", _bitmap(F.col("ranked")))
    n = F.size("ranked")
    first = F.slice("ranked", F.lit(1), _first_words(n, t, side == "s"))
    # ``n`` and the place are enough to bound the words that a pair can share.
    return listed.select(*kept, n.alias("n"), F.posexplode(first).alias("at", "gram")).select(
        "gram", *[F.col(c).alias(f"{side}_{c}") for c in (*kept, "n", "at")]
    )


def _shared_needed(sizes: Column, t: float) -> Column:
    """Shared words that two sets of these sizes together need for an overlap of ``t``."""
    return F.ceil(sizes * F.lit(t / (1 + t)) - MARGIN)


def _word_candidates(
    small: DataFrame, large: DataFrame, plan: JoinPlan, same_size: Column, least_length: float, mapped: bool
) -> DataFrame:
    """Distinct ``(s_id, r_id)``: a key of ``small`` and one of ``large`` with as many words or more.

    With ``mapped``, bitmaps in the postings drop most pairs that don't match before any is written; whole
    texts have many words, and a pair that is verified carries them.
    """
    t, common = plan.overlap, plan.words
    met = common.join(
        _postings(small, t, common, "s", mapped), _postings(large, t, common, "r", mapped), F.col("s_id")
    )
    s_n, r_n = F.col("s_n"), F.col("r_n")
    rest = F.least(s_n - F.col("s_at"), r_n - F.col("r_at"))
    longest, shortest = F.greatest("s_len", "r_len"), F.least("s_len", "r_len")
    needed = _shared_needed(s_n + r_n, t)
    may = F.lit(True)
    if mapped:
        may = (s_n - _lacking("s_map", "r_map") >= needed) & (r_n - _lacking("r_map", "s_map") >= needed)
    return met.filter(
        (F.col("s_id") != F.col("r_id"))
        & ((s_n < r_n) | ((s_n == r_n) & same_size))
        & (s_n >= F.ceil(r_n * F.lit(t) - MARGIN))
        & (shortest >= F.ceil(longest * F.lit(least_length) - MARGIN))
        # At the first word that a pair shares, none before it is shared, so the rest must be enough.
        & (rest >= needed)
        & may
    ).select("s_id", "r_id").distinct()


def _parts(pairs: DataFrame, sizes: DataFrame) -> tuple[DataFrame, int]:
    """``node`` (a hash of the id) of every key in ``pairs``, with its ``component`` and, of the component's
    ``parts``, its ``part``; and how many tasks the components of one part share. ``sizes``: ``(id, n)``.
    """
    edges = pairs.select(F.xxhash64("s_id").alias("u"), F.xxhash64("r_id").alias("v"))
    weights = sizes.groupBy(F.xxhash64("id").alias("node")).agg(F.max("n").alias("n"))
    named = durable(components(edges, "u", "v").join(unsent(weights), "node"))
    keys, items = F.count(F.lit(1)), F.sum("n")
    parts = F.ceil(F.greatest(keys / TILE_KEYS, items / TILE_ITEMS)).cast("long")
    cut = named.groupBy("component").agg(parts.alias("parts"))
    placed = join_hot(named, cut, "component", spread_by=F.col("node"))
    part = F.pmod(F.xxhash64("node"), F.greatest("parts", F.lit(1)))
    total = named.agg(keys.alias("keys"), F.coalesce(items, F.lit(0)).alias("items")).first()
    packs = 1 + int(2 * max(total["keys"] / TILE_KEYS, total["items"] / TILE_ITEMS))
    return durable(placed.select("node", "component", "parts", part.alias("part"))), packs


def _with_shared(pairs: DataFrame, sizes: DataFrame, sets: DataFrame, items: Column) -> DataFrame:
    """``pairs`` with ``s_n``, ``r_n`` (the lengths of both arrays of items) and ``shared``, what both hold.

    ``items`` are distinct values that are cut out of ``sets`` (with ``id``), ``sizes`` says about how many
    there are. No pair takes a set along: keys that pairs connect go together, in components cut into parts
    that fit a task, and a task gets the pairs of two parts and each of their sets once.
    """
    parts, packs = _parts(pairs, sizes)
    s_side, r_side = parts.withColumnsRenamed({"node": "s", "part": "s_part"}), parts.select(F.col("node").alias("r"), F.col("part").alias("r_part"))
    both = pairs.select("s_id", "r_id", F.xxhash64("s_id").alias("s"), F.xxhash64("r_id").alias("r"))
    both = join_hot(both, s_side, "s", spread_by=F.col("r_id"))
    both = join_hot(both, r_side, "r", spread_by=F.col("s_id"), measured=pairs.select(F.xxhash64("r_id").alias("r")))
    alone = F.pmod(F.xxhash64("component"), F.lit(packs))
    tile = F.when(F.col("parts") <= 1, alone).otherwise(F.xxhash64("component", F.least("s_part", "r_part"), F.greatest("s_part", "r_part")))
    tiled = durable(both.select(tile.alias("tile"), "s_id", "r_id"))
    here = F.col("tile").alias("held_by")
    needed = tiled.select(here, F.col("s_id").alias("id")).union(tiled.select(here, "r_id")).distinct()
    held = join_hot(needed, sets, "id", spread_by=F.col("held_by")).select("held_by", "id", items.alias("items"))

    def counted(met: pa.Table, held: pa.Table) -> pa.Table:
        sets = held["items"].combine_chunks()
        n = sets.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        starts = np.concatenate([[0], np.cumsum(n)])
        # Equal values have equal codes, and only they.
        codes = sets.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False)
        held_at = [pc.index_in(met[c], held["id"].combine_chunks()).to_numpy().astype(np.int64) for c in ("s_id", "r_id")]
        order = np.argsort(held_at[0], kind="stable")
        one, two = (at[order] for at in held_at)
        flags, shared = np.zeros(int(codes.max(initial=0)) + 1, bool), np.zeros(len(order), np.int64)
        cuts = np.unique(np.concatenate([np.flatnonzero(np.diff(one)) + 1, np.arange(0, len(one), PAIRS_AT_ONCE), [len(one)]]))
        for low, high in zip(cuts[:-1], cuts[1:]):
            mine = codes[starts[one[low]] : starts[one[low] + 1]]
            flags[mine] = True
            others, ends = two[low:high], np.cumsum(n[two[low:high]])
            first = ends - n[others]
            hits = flags[codes[np.repeat(starts[others] - first, n[others]) + np.arange(ends[-1])]]
            sums = np.concatenate([[0], np.cumsum(hits)])
            shared[low:high] = sums[ends] - sums[first]
            flags[mine] = False
        ids = met.select(["s_id", "r_id"]).take(pa.array(order))
        return ids.append_column("s_n", pa.array(n[one])).append_column("r_n", pa.array(n[two])).append_column("shared", pa.array(shared))

    kinds = dict(pairs.dtypes)
    schema = f"s_id {kinds['s_id']}, r_id {kinds['r_id']}, s_n long, r_n long, shared long"
    return tiled.groupBy("tile").cogroup(held.groupBy("held_by")).applyInArrow(counted, schema)


def _of_both(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("id", "key") if a is b else a.select("id", "key").unionByName(b.select("id", "key"))


def _set_sizes(a: DataFrame, b: DataFrame) -> DataFrame:
    return durable(_of_both(a, b).select("id", F.size(words("key")).alias("n")))


def _by_numbers(pairs: DataFrame, a: DataFrame, b: DataFrame, t: float, sizes: DataFrame | None = None) -> DataFrame:
    """Candidates whose words, as numbers of two bytes, leave an overlap of ``t`` possible.

    Words of one set that have the same number are one there; so many more words may be shared.
    """
    sizes = _set_sizes(a, b) if sizes is None else sizes
    number = F.transform(words("key"), lambda w: (F.xxhash64(w).bitwiseAND(F.lit(0xFFFF)) - 0x8000).cast("short"))
    numbers = _of_both(a, b).select("id", F.array_distinct(number).alias("numbers"))
    both = _with_shared(pairs, sizes, numbers, F.col("numbers")).withColumnsRenamed({"s_n": "s_m", "r_n": "r_m"})
    for side, other in (("s", "r"), ("r", "s")):
        n = sizes.select(F.col("id").alias(f"{side}_id"), F.col("n").alias(f"{side}_n"))
        both = join_hot(both, n, f"{side}_id", spread_by=F.col(f"{other}_id"), measured=pairs)
    fewer = F.least(F.col("s_n") - F.col("s_m"), F.col("r_n") - F.col("r_m"))
    needed = _shared_needed(F.col("s_n") + F.col("r_n"), t)
    return both.filter(F.col("shared") + fewer >= needed).select("s_id", "r_id")


def _by_words(pairs: DataFrame, a: DataFrame, b: DataFrame, t: float) -> DataFrame:
    """Candidates whose word overlap is at least ``t``, with it."""
    sizes = _set_sizes(a, b)
    # Whole texts are heavy: only pairs that are all but sure are compared by words.
    pairs = durable(_by_numbers(pairs, a, b, t, sizes))
    both = _with_shared(pairs, sizes, _of_both(a, b), words("key"))
    score = F.col("shared") / (F.col("s_n") + F.col("r_n") - F.col("shared"))
    return both.select("s_id", "r_id", score.alias("similarity")).filter(F.col("similarity") >= t)


def _verified(pairs: DataFrame, a: DataFrame, b: DataFrame, strategy: str, t: float) -> DataFrame:
    """Candidates ``(s_id, r_id)`` of ``a`` and ``b`` whose exact similarity is at least ``t``."""

    def side(keys: DataFrame, name: str) -> DataFrame:
        # The words are cut out once per key, not once per pair.
        carried = {"levenshtein": ["key"], "combined": ["words", "key"]}[strategy]
        listed = keys.withColumn("words", words("key"))
        return listed.select(*[F.col(c).alias(f"{name}_{c}") for c in ("id", *carried)])

    pairs = durable(pairs)
    if strategy == "jaccard":
        return _by_words(pairs, a, b, t)
    both = join_hot(pairs, side(a, "s"), "s_id", spread_by=F.col("r_id"))
    both = join_hot(both, side(b, "r"), "r_id", spread_by=F.col("s_id"), measured=pairs)
    longest = F.greatest(F.length("s_key"), F.length("r_key"))
    if strategy == "combined":
        both = both.withColumn("_overlap", overlap(F.col("s_words"), F.col("r_words")))
        # The overlap says how many edits are left.
        needed = (F.lit(t) - F.lit(0.3) * F.col("_overlap")) / F.lit(0.7)
        left = F.floor(longest * (F.lit(1) - needed) + MARGIN).cast("int")
    else:
        left = _most_edits(longest, t)
    # Past the edits that are left the built-in stops early and gives -1.
    distance = F.call_function("levenshtein", F.col("s_key"), F.col("r_key"), F.col("_left"))
    scored = both.withColumn("_left", left).filter("_left >= 0").withColumn("_edits", distance).filter("_edits >= 0")
    score = F.lit(1) - F.col("_edits") / longest
    if strategy == "combined":
        score = blend(score, F.col("_overlap"))
    return scored.select("s_id", "r_id", score.alias("similarity")).filter(F.col("similarity") >= t)


# What is measured before a join


def common_items(keys: DataFrame, strategy: str, threshold: float) -> JoinPlan:
    """The plan for pairs of ``keys``; also good for subsets of them."""
    t = threshold
    if strategy == "levenshtein":
        plan = JoinPlan(share=t)
    else:
        hashes = F.transform(words("key"), lambda w: F.xxhash64(w))
        common = Commonness.of(keys.select(F.explode(hashes).alias("item")))
        if strategy == "jaccard":
            return JoinPlan(common, t)
        bound = _cheapest_overlap(keys, common, t)
        # The margin keeps a share that only rounding lifts above the overlap on the other path.
        plan = JoinPlan(common, bound, (t - 0.3 * bound) / 0.7 - MARGIN if bound > word_share(strategy, t) else 2.0)
    if 0.5 < plan.share <= 1:
        plan.single, plan.paired = _cheapest_chunks(keys, plan.share)
    return plan


def _cheapest_overlap(keys: DataFrame, common: Commonness, t: float) -> float:
    """The least overlap at which the first words of the keys meet few others.

    A lower one leaves pairs to the chunk join that need more edit similarity, which is cheaper there.
    """
    least = word_share("combined", t)
    choices = sorted({max(least, 0.05), *(c for c in OVERLAP_CHOICES if c > least)})
    levels = keys.select(_ranked_words(common).alias("ranked"))
    n = F.size("ranked")

    def met(j: float) -> Column:
        first = F.slice("ranked", F.lit(1), _first_words(n, j, True))
        return F.aggregate(first, F.lit(0.0), lambda acc, w: acc + rank_count(w))

    costs = levels.agg(F.count(F.lit(1)).alias("n"), *[F.sum(met(j)).alias(f"c{k}") for k, j in enumerate(choices)]).first()
    cheap = [j for k, j in enumerate(choices) if (costs[f"c{k}"] or 0) <= WORD_MATCHES * costs["n"]]
    return cheap[0] if cheap else choices[-1]


def _cheapest_chunks(keys: DataFrame, share: float) -> tuple[Commonness, Commonness | None]:
    """The chunk lengths whose picked chunks meet the fewest others, alone and, if cheaper, by two."""
    length, n_keys = F.length("key"), keys.count()
    ways = (1, 2) if n_keys >= LEAST_PAIRED else (1,)
    options = [(needed, shorter) for needed in ways for shorter in CHUNK_CHOICES]

    def hashes(option: Commonness) -> Column:
        return _chunk_hashes(F.col("key"), length, _gram_size(length, share, option))

    def items(k: int, option: Commonness) -> Column:
        return F.transform(hashes(option), lambda h: F.struct(F.lit(k).alias("choice"), h.alias("item")))

    every = [items(k, Commonness({}, shorter, needed)) for k, (needed, shorter) in enumerate(options)]
    counted = (
        keys.select(F.inline(F.concat(*every)))
        .groupBy("choice", key_bucket(F.col("item")).alias("bucket"))
        .count()
        .toArrow()
    )
    counts: dict[int, dict[int, int]] = {k: {} for k in range(len(options))}
    for k, bucket, n in zip(*(counted[c].to_pylist() for c in ("choice", "bucket", "count"))):
        counts[k][bucket] = n
    choices = [Commonness(counts[k], shorter, needed, n_keys) for k, (needed, shorter) in enumerate(options)]

    def cost(k: int, choice: Commonness) -> Column:
        edits = _most_edits_of_shorter(F.col("len"), share) + 1
        met = F.aggregate(f"picked{k}", F.lit(0.0), lambda acc, c: acc + rank_count(c["rank"]))
        alone = met * edits * CANDIDATE_COST
        if choice.needed == 1:
            return alone
        # Two chunks meet by chance as often as their frequencies say; the longer side lists about
        # 1.4 d^3 pairs. Keys without enough rare chunks go on meeting by one.
        by_two = met * met / 2 / max(n_keys, 1) * edits * edits * CANDIDATE_COST
        return F.when(_pairable(share, choice, f"picked{k}"), by_two + F.pow(edits, F.lit(3)) * 1.4).otherwise(alone)

    hashed = keys.select(length.alias("len"), *[hashes(c).alias(f"hashes{k}") for k, c in enumerate(choices)])
    picked = [_picked_chunks(F.col(f"hashes{k}"), F.col("len"), share, c).alias(f"picked{k}") for k, c in enumerate(choices)]
    sums = [F.sum(cost(k, c)).alias(f"c{k}") for k, c in enumerate(choices)]
    found = hashed.select("len", *picked).agg(*sums).first().asDict() if n_keys else {}
    if not found:
        return choices[0], None

    def cheapest(needed: int) -> int:
        return min((k for k, c in enumerate(choices) if c.needed == needed), key=lambda k: (found[f"c{k}"], k))

    single, paired = cheapest(1), cheapest(2) if 2 in ways else None
    if paired is None or found[f"c{paired}"] >= found[f"c{single}"]:
        return choices[single], None
    return choices[single], choices[paired]


def _check(strategy: str, t: float, allow_all_pairs: bool) -> None:
    if strategy != "jaccard" and edit_share(strategy, t) <= 0.5 and not allow_all_pairs:
        raise ValueError(
            f"a {strategy} threshold of {t} leaves nothing to join on but the length; pass "
            "allow_all_pairs=True to compare all keys of similar length"
        )


def known_strategy(strategy: str) -> str:
    return strategy if strategy in ("jaccard", "combined") else "levenshtein"


def _candidates(a: DataFrame, b: DataFrame, plan: JoinPlan, same: Column, strategy: str, t: float) -> DataFrame:
    """Distinct candidates in which the key of ``a`` is the smaller or shorter one; ``same`` settles ties."""
    found = []
    if plan.words is not None:
        least = 0.0 if strategy == "jaccard" else max(edit_share(strategy, t), 0.0)
        found.append(_word_candidates(a, b, plan, same, least, strategy == "jaccard"))
    if plan.share <= 1:
        found.append(_chunk_candidates(a, b, plan, same))
    return reduce(DataFrame.unionByName, found)


def similarity_pairs(
    keys: DataFrame,
    strategy: str = "levenshtein",
    threshold: float | None = None,
    allow_all_pairs: bool = False,
    common: JoinPlan | None = None,
) -> DataFrame:
    """All pairs ``(left_id, right_id, similarity)``, left below right, at or above the threshold."""
    t = require_threshold(threshold)
    strategy = known_strategy(strategy)
    _check(strategy, t, allow_all_pairs)
    plan = common_items(keys, strategy, t) if common is None else common
    found = _candidates(keys, keys, plan, F.col("s_id") < F.col("r_id"), strategy, t)
    # The word join and the chunk join may give a pair in either direction.
    pairs = found.select(F.least("s_id", "r_id").alias("s_id"), F.greatest("s_id", "r_id").alias("r_id"))
    if plan.words is not None and plan.share <= 1:
        pairs = pairs.distinct()
    return _verified(pairs, keys, keys, strategy, t).select(
        F.col("s_id").alias("left_id"), F.col("r_id").alias("right_id"), "similarity"
    )


def similarity_pairs_between(
    a: DataFrame,
    b: DataFrame,
    strategy: str,
    threshold: float,
    common: JoinPlan,
    allow_all_pairs: bool = False,
) -> DataFrame:
    """All pairs ``(a_id, b_id, similarity)`` of a key of ``a`` and a key of ``b``."""
    strategy = known_strategy(strategy)
    _check(strategy, threshold, allow_all_pairs)
    there = _candidates(a, b, common, F.lit(True), strategy, threshold)
    back = _candidates(b, a, common, F.lit(False), strategy, threshold)
    back = back.select(F.col("r_id").alias("s_id"), F.col("s_id").alias("r_id"))
    pairs = there.unionByName(back).distinct()
    return _verified(pairs, a, b, strategy, threshold).select(
        F.col("s_id").alias("a_id"), F.col("r_id").alias("b_id"), "similarity"
    )


def row_pairs(
    rows: DataFrame,
    key: str = "comparison_value",
    strategy: str = "levenshtein",
    threshold: float | None = None,
    row_id: str = "row_id",
    allow_all_pairs: bool = False,
) -> DataFrame:
    """Similarity pairs between the first rows of the distinct keys of a table."""
    keys = durable(distinct_keys(rows, key, row_id))
    return similarity_pairs(keys, strategy, threshold, allow_all_pairs)
