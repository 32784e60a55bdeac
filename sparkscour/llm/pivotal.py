"""Mixing sources to target weights by pivotal dependent rounding.

Each document should be copied ``target / source_size`` times, which is a whole number and a
fraction. Two fractional documents meet and one hands words to the other, in a random direction
that keeps the expectation of both, until one of them is a whole number of copies; the other goes on
to meet the next. A source's words are thus kept exactly, but for the one document left at the end.
Chunks of documents are settled side by side, and what is left of each chunk meets in a tree. Long
documents meet first, so that the one left at the end is likely a short one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from sparkscour.llm.common import let_all, name, packed, text_of, unpacked, words_of
from sparkscour.operators.rows import distributed_rank
from sparkscour.session import durable

WEIGHTS = (5, 2, 1)
MOST_COPIES = 3
# Documents of a chunk on average in the largest source, and children of a node of the tree.
FAN_IN = 32
# Copies of a source's row, so that joins on a source which holds most documents are spread.
SALTS = 64

KEY = ["_null", "_source", "_nodoc", "_doc", "_size"]


def keyed(docs: DataFrame) -> DataFrame:
    """Columns of ``KEY``, without nulls, and the whole row as ``_row``."""
    source, doc = name("source").cast("string"), name("doc_id").cast("long")
    return docs.select(
        source.isNull().alias("_null"),
        F.coalesce(source, F.lit("")).alias("_source"),
        doc.isNull().alias("_nodoc"),
        F.coalesce(doc, F.lit(0)).alias("_doc"),
        F.size(words_of(text_of(docs))).cast("long").alias("_size"),
        packed(docs).alias("_row"),
    )


def source_targets(
    sources: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES
) -> DataFrame:
    """Adds ``target`` to rows of ``_null``, ``_source``, ``source_size``.

    Sources by code point, null last, have the weights in turn. All words are shared by weight; a
    target above ``most`` times its source is cut to that, and the others share the rest, again
    and again. Only sums go to the driver, and a round caps at least one more source.
    """
    ranked = durable(distributed_rank(sources, ["_null", "_source"], rank_col="_rank"))
    turn = F.array(*[F.lit(int(w)) for w in weights])
    weight = F.element_at(turn, (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    weighed = ranked.select("_null", "_source", "source_size", weight.cast("long").alias("_weight"))
    cap = F.col("source_size") * F.lit(most)
    total = weighed.agg(F.sum("source_size")).first()[0] or 0
    rest, open_weight, level = total, None, None
    while True:
        # target = weight * rest / open_weight, compared in whole numbers
        over = F.lit(False) if level is None else F.col("_weight") * F.lit(level) > cap
        found = weighed.agg(
            F.sum(F.when(over, cap).otherwise(F.lit(0))).alias("capped"),
            F.sum(F.when(over, F.lit(0)).otherwise(F.col("_weight"))).alias("weight"),
        ).first()
        now = total - (found["capped"] or 0), found["weight"] or 0
        if now == (rest, open_weight) or not now[1]:
            break
        (rest, open_weight), level = now, now[0] / now[1]
    share = F.col("_weight") * F.lit(float(level or 0.0))
    return weighed.withColumn("target", F.when(share > cap, cap.cast("double")).otherwise(share)).drop("_weight")


def chance(seed: int, *parts: Column) -> Column:
    """A number from 0 to 1 that depends on the parts alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *parts), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))


def settle(items: Column, seed: int, *place: Column) -> Column:
    """Let the fractional ``items`` (structs with ``p`` and ``size``) meet in their order.

    Returns ``ups``, the positions that became 1; ``held``, the position left over (or -1), with its
    ``p`` and ``size``. All others became 0. Items of no size or a whole ``p`` don't take part.
    """

    def state(ups: Column, held: Column, p: Column, size: Column) -> Column:
        return F.struct(
            ups.alias("ups"), held.cast("int").alias("held"), p.cast("double").alias("p"), size.cast("long").alias("size")
        )

    def meet(acc: Column, at: Column) -> Column:
        item = F.element_at(items, at + 1)

        def pair(v: Column) -> Column:
            a, p, b, q = v["a"], v["p"], v["b"], v["q"]

            def moved(w: Column) -> Column:
                """``up`` words go to the held one, or ``down`` words to the new one."""
                up, down = w["up"], w["down"]
                gains = chance(seed, *place, acc["held"], at) * (up + down) < down
                full, empty = a * (1 - p) <= b * q, b * q <= a * (1 - p)
                drained, filled = a * p <= b * (1 - q), b * (1 - q) <= a * p
                none = F.lit(-1)
                held_up, new_up = F.array_append(acc["ups"], acc["held"]), F.array_append(acc["ups"], at)
                return (
                    F.when(gains & full & empty, state(held_up, none, F.lit(0.0), F.lit(0)))
                    .when(gains & full, state(held_up, at, q - up / b, b))
                    .when(gains, state(acc["ups"], acc["held"], p + up / a, a))
                    .when(drained & filled, state(new_up, none, F.lit(0.0), F.lit(0)))
                    .when(drained, state(acc["ups"], at, q + down / b, b))
                    .otherwise(state(new_up, acc["held"], p - down / a, a))
                )

            return let_all({"up": F.least(a * (1 - p), b * q), "down": F.least(a * p, b * (1 - q))}, moved)

        both = let_all({"a": acc["size"], "p": acc["p"], "b": item["size"], "q": item["p"]}, pair)
        return (
            F.when((item["size"] <= 0) | (item["p"] <= 0), acc)
            .when(acc["held"] < 0, state(acc["ups"], at, item["p"], item["size"]))
            .otherwise(both)
        )

    start = state(F.array().cast("array<int>"), F.lit(-1), F.lit(0.0), F.lit(0))
    places = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.size(items) - 1)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(places, start, meet)


def units_of(docs: DataFrame) -> DataFrame:
    """Equal rows (source, id, number of words) as one unit, counted before the shuffle."""
    return keyed(docs).groupBy(*KEY).agg(F.count(F.lit(1)).alias("_rows"))


def plan_copies(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1
) -> DataFrame:
    """Copies of each unit: ``KEY``, ``_rows``, ``source_size``, ``target``, ``_copies``.

    Rows that agree in source, id and number of words are one unit with as many copies as all of
    them should have, so that no hash bucket can hold many of them.
    """
    units = durable(units_of(docs))
    sources = units.groupBy("_null", "_source").agg(
        F.sum(F.col("_size") * F.col("_rows")).alias("source_size"), F.count(F.lit(1)).alias("_units")
    )
    sources = durable(sources)
    largest = sources.agg(F.max("_units")).first()[0] or 0
    targets = source_targets(sources.drop("_units"), weights, most)
    buckets = 1
    while buckets * FAN_IN < largest:
        buckets *= 2
    bucket = F.pmod(F.xxhash64(F.lit(seed), "_nodoc", "_doc", "_size"), F.lit(buckets))
    order = F.xxhash64(F.lit(seed + 1), "_nodoc", "_doc", "_size")
    salt = F.pmod(F.col("_bucket"), F.lit(SALTS))
    chunks = (
        units.withColumn("_bucket", bucket)
        .groupBy("_null", "_source", "_bucket")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct((-F.col("_size")).alias("place"), order.alias("order"), *[F.col(c).alias(c) for c in (*KEY[2:], "_rows")])
                )
            ).alias("_units")
        )
        .withColumn("_salt", salt)
    )
    spread = targets.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))

    def item(u: Column) -> Column:
        want = u["_rows"] * F.col("_ratio")
        return F.struct(
            *[u[c].alias(c) for c in (*KEY[2:], "_rows")],
            u["_size"].alias("size"),
            F.floor(want).alias("whole"),
            (want - F.floor(want)).alias("p"),
        )

    settled = (
        chunks.join(spread, ["_null", "_source", "_salt"])
        .withColumn("_ratio", ratio)
        .select("_null", "_source", "_bucket", "source_size", "target", F.transform("_units", item).alias("_items"))
    )
    settled = durable(
        settled.withColumn("_end", settle(F.col("_items"), seed, F.lit(0), F.col("_null"), F.col("_source"), F.col("_bucket")))
    )
    result = resolve(settled.select("_null", "_source", "_bucket", "_end"), buckets, seed)
    last = F.col("_up")
    listed = settled.join(result, ["_null", "_source", "_bucket"], "left").select(
        "_null", "_source", "source_size", "target", "_end", last, F.posexplode("_items").alias("_at", "_item")
    )
    loose = chance(seed + 2, F.col("_source"), F.col("_item._nodoc"), F.col("_item._doc")) < F.col("_item.p")
    extra = (
        F.when(F.col("_item._size") <= 0, loose)
        .when(F.col("_at") == F.col("_end.held"), F.coalesce(last, F.lit(False)))
        .otherwise(F.array_contains("_end.ups", F.col("_at")))
    )
    return listed.select(
        "_null",
        "_source",
        *[F.col(f"_item.{c}").alias(c) for c in (*KEY[2:], "_rows")],
        "source_size",
        "target",
        (F.col("_item.whole") + extra.cast("long")).alias("_copies"),
    )


def resolve(ends: DataFrame, buckets: int, seed: int) -> DataFrame:
    """Whether the document left over in each chunk gets its copy: ``_null``, ``_source``, ``_bucket``, ``_up``.

    Level by level, the left-over documents of ``FAN_IN`` neighbouring nodes of one source meet in
    their parent; at the root the last one is rounded. The answers then go back down the tree.
    """
    here = ["_null", "_source", "_bucket"]
    levels = []
    nodes, width, level = ends, buckets, 0
    while width > 1:
        level += 1
        width = -(-width // FAN_IN)
        left = nodes.filter(F.col("_end.held") >= 0).select(
            "_null",
            "_source",
            F.col("_bucket").alias("_child"),
            F.floor(F.col("_bucket") / F.lit(FAN_IN)).alias("_bucket"),
            F.col("_end.p").alias("p"),
            F.col("_end.size").alias("size"),
        )
        parents = left.groupBy(*here).agg(
            F.sort_array(
                F.collect_list(F.struct((-F.col("size")).alias("place"), F.col("_child").alias("child"), "p", "size"))
            ).alias("_items")
        )
        nodes = durable(
            parents.withColumn("_end", settle(F.col("_items"), seed, F.lit(level), *[F.col(c) for c in here]))
        )
        levels.append(nodes)
    # One document per source: the nearer whole number brings the source closest to its target.
    known = nodes.select(*here, (F.col("_end.p") >= 0.5).alias("_up"))
    for nodes in reversed(levels):
        up = (
            F.when(F.col("_at") == F.col("_end.held"), F.coalesce(F.col("_up"), F.lit(False)))
            .otherwise(F.array_contains("_end.ups", F.col("_at")))
        )
        known = nodes.join(known, here, "left").select(
            "_null", "_source", "_end", "_up", F.posexplode("_items").alias("_at", "_item")
        ).select("_null", "_source", F.col("_item.child").alias("_bucket"), up.alias("_up"))
    return known


def share(total: Column, rows: Column, turn: Column) -> Column:
    """The copies of the ``turn``-th (from 1) of ``rows`` equal rows that have ``total`` copies."""
    return F.floor(total / rows) + (turn <= F.pmod(total, rows)).cast("long")


def mix_report(
    docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1
) -> DataFrame:
    """A row per document: ``doc_id``, ``source``, ``size``, ``source_size``, ``target``, ``copies``, ``taken``.

    ``taken`` is copies times words; a source's sum is within one document of its target, and no
    document is taken more than ``most`` times. A null source is a source, a null or empty text has
    no words and takes nothing; such a document still has copies, of no words. Equal rows share
    their copies evenly. The result depends on the rows alone, not on their order or partitions.
    An empty table gives an empty one.
    """
    plan = plan_copies(docs, weights, most, seed)
    each = plan.withColumn("_turn", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_rows"))))
    copies = share(F.col("_copies"), F.col("_rows"), F.col("_turn"))
    return each.select(
        F.when(~F.col("_nodoc"), F.col("_doc")).alias("doc_id"),
        F.when(~F.col("_null"), F.col("_source")).alias("source"),
        F.col("_size").alias("size"),
        "source_size",
        "target",
        copies.alias("copies"),
        (copies * F.col("_size")).alias("taken"),
    )


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, most: int = MOST_COPIES, seed: int = 1) -> DataFrame:
    """The mixed rows themselves: each row of ``docs`` as often as it is copied, columns unchanged."""
    plan = plan_copies(docs, weights, most, seed).select(*KEY, "_rows", "_copies")
    turn = F.row_number().over(Window.partitionBy(*KEY).orderBy(F.xxhash64(F.col("_row")))).cast("long")
    counted = keyed(docs).withColumn("_turn", turn).join(plan, KEY)
    copies = share(F.col("_copies"), F.col("_rows"), F.col("_turn"))
    many = counted.withColumn("_n", copies).filter(F.col("_n") > 0)
    repeated = many.select("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_n"))).alias("_copy"))
    return unpacked(repeated, "_row", docs.columns)
