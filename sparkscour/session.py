"""Session helpers: durable lineage cuts and joins on keys that may be very hot."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A join key with more rows than this on the many side is split over several tasks.
HOT_KEY_ROWS = 1_000_000
# Keys are measured per hash bucket, so measuring never ships more than this many numbers.
KEY_BUCKETS = 1 << 16


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``, or one beside the warehouse's tables."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and cut its lineage.

    The rows survive the loss of any executor, and later jobs all see one fixed version of them.
    """
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def unsent(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join that is shuffled and sorted, whatever its size is taken for.

    Spark estimates a join's side from the files it came from, so rows that were listed from each row of a
    small file, or hashes in a compressed shuffle, may be sent whole to the driver and to all tasks.
    """
    return df.hint("merge")


def key_bucket(item: Column) -> Column:
    return F.pmod(item, F.lit(KEY_BUCKETS)).cast("int")


def salts_of(counts: dict[int, int], hot_rows: int) -> dict[int, list[int]]:
    """Salts (a power of two) -> buckets, for the buckets that are too large for one task.

    A bucket is hot above ``hot_rows``, and above four times the mean, which any task has to
    bear anyway.
    """
    limit = max(hot_rows, 4 * sum(counts.values()) // KEY_BUCKETS)
    salts: dict[int, list[int]] = {}
    for bucket, rows in counts.items():
        if rows > limit:
            salts.setdefault(1 << (rows // limit).bit_length(), []).append(bucket)
    return salts


def salted_join(
    many: DataFrame,
    one: DataFrame,
    on: list[str],
    how: str,
    bucket: Column,
    salts: dict[int, list[int]],
    spread_by: Column,
) -> DataFrame:
    """Equality join in which hot buckets of ``many`` are spread over salts.

    The matching rows of ``one`` are copied to each salt. ``how`` may be ``inner``, ``left``,
    ``left_semi`` or ``left_anti``.
    """
    if not salts:
        return many.join(unsent(one), on, how)
    n = F.lit(1).cast("long")
    for level, buckets in salts.items():
        n = F.when(bucket.isin(*buckets), F.lit(level).cast("long")).otherwise(n)
    left = many.withColumn("_salt", F.pmod(F.xxhash64(spread_by), n))
    right = one.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return left.join(unsent(right), [*on, "_salt"], how).drop("_salt")


def join_hot(
    many: DataFrame,
    one: DataFrame,
    on: str | list[str],
    how: str = "inner",
    spread_by: Column | None = None,
    hot_rows: int = HOT_KEY_ROWS,
    measured: DataFrame | None = None,
    weight: str | None = None,
) -> DataFrame:
    """Join ``many``, in which one key may hold any share of the rows, to ``one``.

    One small job counts the rows of ``many`` per key bucket, combined before the shuffle; only
    buckets above ``hot_rows`` are reported. ``measured`` is a cheaper table with the same keys
    to count on, ``weight`` its column of row counts.
    """
    keys = [on] if isinstance(on, str) else list(on)
    bucket = key_bucket(F.xxhash64(*keys))
    rows = F.count(F.lit(1)) if weight is None else F.sum(weight)
    counted = (many if measured is None else measured).groupBy(bucket.alias("bucket"))
    hot = counted.agg(rows.alias("rows")).filter(F.col("rows") > hot_rows).collect()
    salts = salts_of({r["bucket"]: r["rows"] for r in hot}, hot_rows)
    spread = spread_by if spread_by is not None else F.monotonically_increasing_id()
    return salted_join(many, one, keys, how, bucket, salts, spread)
