"""Exact percentiles of a column with any number of distinct values."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.session import scratch_dir

ACCURACY = 10_000
MOST = 50_000  # distinct values of a bracket that are ranked in one task
PARTS = 1_024  # of a bracket that holds more
SMALL = 10 * ACCURACY  # groups up to this many rows are ranked whole


def exact_percentiles(
    df: DataFrame, value: str, probs: dict[str, float], keys: Sequence[str] = (), most: int = MOST,
) -> DataFrame:
    """`keys, n, min, max, <name>...`, interpolated linearly between neighbouring ranks.

    The built-in exact percentile keeps every distinct value of a group in one task. Here a
    mergeable sketch brackets each percentile to a sliver of the rows (4 parts in ACCURACY);
    a second pass counts the rows below each bracket and the values inside it. While a bracket
    holds more than `most` values, it is cut into `PARTS` of equal width and only the part that
    holds the rank asked for goes on, so what one task ranks is bounded whatever the rows. Nulls
    are ignored; a group without values gives no row.
    """
    keys = list(keys)
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).filter("_v is not null")
    names = list(probs)
    margin = 2 / ACCURACY
    edges = [max(0.0, p - margin) for p in probs.values()] + [min(1.0, p + margin) for p in probs.values()]
    sketch = rows.groupBy(*keys).agg(
        F.percentile_approx("_v", F.array(*[F.lit(e) for e in edges]), ACCURACY).alias("_e"),
        F.min("_v").alias("min"), F.max("_v").alias("max"), F.count(F.lit(1)).alias("n"),
    ).filter("n > 0")
    edge = lambda outer, i, end: F.when(
        F.lit(outer) | (F.col("n") <= SMALL), F.lit(float(end))).otherwise(F.col("_e")[i])
    exact = lambda p: F.lit(p) * (F.col("n") - 1)
    # A percentile lies between two ranks, each looked for on its own.
    wanted = F.array(*[
        F.struct(
            F.lit(name).alias("name"), F.lit(side).alias("side"),
            near(exact(p)).cast("bigint").alias("rank"), exact(p).alias("at"),
            edge(p <= margin, i, "-inf").alias("lo"),
            edge(p >= 1 - margin, len(names) + i, "inf").alias("hi"),
        )
        for i, (name, p) in enumerate(probs.items()) for side, near in (("a", F.floor), ("b", F.ceil))
    ])
    # One row per group: every row of the table carries its group's few brackets.
    bracketed = (
        rows.join(sketch.select(*keys, wanted.alias("_w")), keys) if keys
        else rows.withColumn("_k", F.lit(1)).join(
            F.broadcast(sketch.select(F.lit(1).alias("_k"), wanted.alias("_w"))), "_k").drop("_k")
    )
    placed = bracketed.select(*keys, "_v", F.inline("_w"))
    # Rows below a bracket collapse to one counter; rows above it are not needed.
    below = F.col("_v") < F.col("lo")
    of = [*keys, "name", "side", "rank", "at"]
    counted = _narrowed(
        placed.filter(F.col("_v") <= F.col("hi"))
        .groupBy(*of, F.when(below, F.lit(None).cast("double")).otherwise(F.col("_v")).alias("_x"))
        .agg(F.count(F.lit(1)).alias("_c")), of, most)
    ranked = _placed(counted, of, F.asc_nulls_first("_x"))  # at most `most` rows in a window
    found = ranked.filter((F.col("_start") <= F.col("rank")) & (F.col("rank") < F.col("_end")))
    side = lambda s: F.max(F.when(F.col("side") == s, F.col("_x")))
    picked = found.groupBy(*keys, "name", "at").agg(side("a").alias("a"), side("b").alias("b")).select(
        *keys, "name", (F.col("a") + (F.col("at") - F.floor("at")) * (F.col("b") - F.col("a"))).alias("q"))
    wide = picked.groupBy(*keys).pivot("name", names).agg(F.first("q"))
    totals = sketch.select(*keys, "n", "min", "max")
    if keys:
        return totals.join(wide, keys)
    return totals.withColumn("_k", F.lit(1)).join(wide.withColumn("_k", F.lit(1)), "_k").drop("_k")


def _placed(rows: DataFrame, of: Sequence[str], order) -> DataFrame:
    """Rows with the first rank they stand for and the one after their last."""
    window = Window.partitionBy(*of).orderBy(order)
    return rows.withColumn("_end", F.sum("_c").over(window)).withColumn("_start", F.col("_end") - F.col("_c"))


def _narrowed(counted: DataFrame, of: Sequence[str], most: int) -> DataFrame:
    """Values and counts `_x, _c` with no more than `most` values for each rank asked for. A null
    value stands for all rows below."""
    spark, of = counted.sparkSession, list(of)
    while True:
        path = scratch_dir(spark, "brackets")
        counted.write.parquet(path)
        counted = spark.read.parquet(path)
        spans = counted.groupBy(*of).agg(F.count(F.lit(1)).alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
        if (spans.agg(F.max("_n")).first()[0] or 0) <= max(most, 2):
            return counted
        # Halves, so that the width of a bracket of any doubles is a double.
        share = (F.col("_x") / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2)
        part = F.when(F.col("_x").isNull(), -1).when(F.col("_hi") <= F.col("_lo"), 0).otherwise(
            F.least(F.floor(share * PARTS), F.lit(PARTS - 1)))
        cut = counted.join(spans.drop("_n"), of).withColumn("_part", part.cast("int"))
        held = _placed(cut.groupBy(*of, "_part").agg(F.sum("_c").alias("_c")), of, F.asc("_part"))  # PARTS + 1 rows
        held = held.filter(F.col("_start") <= F.col("rank")).select(
            *of, "_part", (F.col("_end") <= F.col("rank")).alias("_below"))
        counted = cut.join(held, [*of, "_part"]).groupBy(
            *of, F.when(F.col("_below"), F.lit(None).cast("double")).otherwise(F.col("_x")).alias("_x")).agg(F.sum("_c").alias("_c"))
