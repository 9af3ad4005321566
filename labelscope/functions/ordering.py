"""Reproducible orders: rows sort by the md5 of `seed:key`, so the same rows come out in the
same order on any engine, with any partitioning."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.session import scratch_dir

# Rows of a broadcast offset table; each is a few dozen bytes, so this is well below 100 MB.
BROADCAST_ROWS = 1_000_000


def order_hash(seed: int | str | Column, *keys: str | Column) -> Column:
    """md5 hex of `seed:key[:key...]`; 32 lower-case hex digits, uniform over the key."""
    head = seed if isinstance(seed, Column) else F.lit(str(seed))
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    return F.md5(F.concat_ws(":", head.cast("string"), *[c.cast("string") for c in cols]))


def hash_integer(digest: Column, digits: int = 8) -> Column:
    """The first `digits` hex digits of a digest as a bigint."""
    return F.conv(F.substring(digest, 1, digits), 16, 10).cast("bigint")


def rank_in_group(
    df: DataFrame,
    group: Sequence[str],
    key: str,
    seed: int | Column,
    out: str = "rank",
    limit: int | None = None,
    limits: Callable[[DataFrame], DataFrame] | None = None,
    n_groups: int | None = None,
    digits: int = 4,
    carry: Sequence[str] = (),
) -> DataFrame:
    """Number the rows of each group 1, 2, ... in `order_hash(seed, key)` order.

    A plain `row_number` over the group sorts the whole group in one task. Here each group is
    cut into 16**digits slices by the leading digits of the hash, which is uniform whatever
    the data, so a group holding a third of all rows still spreads evenly. Slice counts give
    each slice its first rank; rows are numbered inside their slice only.

    `limit` keeps ranks up to a bound; `limits` makes a table `group columns, _limit` from the
    group sizes (`group columns, c`), which come from the slice counts without another scan.
    Slices that start beyond the limit drop out in the join, before any row is shuffled. `carry`
    names further columns of that table to hand on. Group columns must not be null.
    """
    group = list(group)
    hashed = df.withColumn("_h", order_hash(seed, key)).withColumn(
        "_slice", F.substring("_h", 1, digits)
    )
    by_group = Window.partitionBy(*group).orderBy("_slice")
    slices = hashed.groupBy(*group, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    starts = slices.withColumn("_start", F.sum("_n").over(by_group) - F.col("_n")).drop("_n")
    if limits is not None:
        sizes = slices.groupBy(*group).agg(F.sum("_n").alias("c"))
        starts = starts.join(limits(sizes).select(*group, "_limit", *carry), group)
    elif limit is not None:
        starts = starts.withColumn("_limit", F.lit(limit).cast("bigint"))
    if "_limit" in starts.columns:
        starts = starts.filter(F.col("_start") < F.col("_limit"))
    # Every kept slice starts below the limit and holds a row: at most `limit` per group.
    if limit is not None and n_groups is not None:
        if n_groups * min(limit, 16**digits) <= BROADCAST_ROWS:
            starts = F.broadcast(starts)
    in_slice = Window.partitionBy(*group, "_slice").orderBy("_h", key)
    ranked = hashed.join(starts, [*group, "_slice"]).withColumn(
        out, F.col("_start") + F.row_number().over(in_slice)
    )
    if "_limit" in starts.columns:
        ranked = ranked.filter(F.col(out) <= F.col("_limit")).drop("_limit")
    return ranked.select(*df.columns, out, *carry)


def dense_position(
    df: DataFrame,
    bucket: Sequence[str],
    order: Sequence[str],
    out: str = "pos",
    small_buckets: bool = False,
) -> DataFrame:
    """Number all rows 1, 2, ... by `order` without sorting the table in one task.

    `bucket` columns are a coarsening of the order: sorting by bucket first must not change
    it. Rows are numbered inside their bucket and shifted by the rows in earlier buckets. The
    running total is over the bucket counts, a table whose size the caller bounds.
    """
    bucket = list(bucket)
    running = Window.orderBy(*bucket).rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        df.groupBy(*bucket)
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_start", F.coalesce(F.sum("_n").over(running), F.lit(0)))
        .drop("_n")
    )
    if small_buckets:
        starts = F.broadcast(starts)
    inside = Window.partitionBy(*bucket).orderBy(*order)
    return (
        df.join(starts, bucket)
        .withColumn(out, F.col("_start") + F.row_number().over(inside))
        .drop("_start")
    )


def range_position(df: DataFrame, order: Sequence[str], out: str = "pos") -> DataFrame:
    """Number all rows 1, 2, ... by `order`, whose columns may be of any type that sorts.

    Rows are range-partitioned, sorted and numbered inside their partition and written once;
    the read-back is shifted by the rows of earlier partitions, one number per partition.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, "ranges")
    # The lower 33 bits of the id count the rows of a partition in their order.
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) + 1
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged.withColumns({"_part": F.spark_partition_id(), "_at": inside}).write.parquet(path)
    rows = spark.read.parquet(path)
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select(
        "_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"))
    # One row per partition of the shuffle above.
    placed = rows.join(F.broadcast(starts), "_part").withColumn(out, F.col("_start") + F.col("_at"))
    return placed.select(*df.columns, out)
