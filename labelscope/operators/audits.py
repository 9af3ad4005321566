"""Checks on the input data: nulls, balance, lengths, drift, row order, coverage, probes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.scoring import is_correct


def null_counts(df: DataFrame) -> DataFrame:
    """`column, dtype, nulls` from one pass over the table."""
    wide = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    stacked = ", ".join(f"'{c}', '{t}', `{c}`" for c, t in df.dtypes)
    return wide.selectExpr(f"stack({len(df.columns)}, {stacked}) as (column, dtype, nulls)")


def class_balance(df: DataFrame, label: str, rare_below: int) -> DataFrame:
    """Smallest, median, mean and largest class, and how many classes are rare."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("c"))
    return counts.agg(
        F.count(F.lit(1)).alias("n_classes"),
        F.min("c").alias("min_rows"),
        F.min_by(label, F.struct("c", label)).alias("min_class"),
        F.round(F.percentile("c", 0.5), 6).alias("median_rows"),
        F.round(F.avg("c"), 6).alias("mean_rows"),
        F.max("c").alias("max_rows"),
        F.max_by(label, F.struct("c", label)).alias("max_class"),
        F.count_if(F.col("c") < rare_below).alias("rare_classes"),
    )


def rare_classes(df: DataFrame, label: str, below: int) -> DataFrame:
    """The classes with fewer rows than `below`."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows")).filter(F.col("n_rows") < below)


def length_stats(df: DataFrame, length: Column, cutoffs: Sequence[int]) -> DataFrame:
    """Minimum, median, p95, p99, maximum, and the share of rows longer than each cutoff.

    `percentile` is exact and keeps one counter per distinct length, not per row.
    """
    lengths = df.select(length.alias("n"))
    stats = lengths.agg(
        F.min("n").alias("min_len"),
        F.percentile("n", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99))).alias("q"),
        F.max("n").alias("max_len"),
        *[F.round(F.avg((F.col("n") > c).cast("double")), 6).alias(f"over_{c}") for c in cutoffs],
    )
    return stats.select(
        "min_len",
        *[F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("median_len", "p95_len", "p99_len"))],
        "max_len",
        *[f"over_{c}" for c in cutoffs],
    )


def class_drift(a: DataFrame, b: DataFrame, label: str, smoothing: float = 1e-12) -> DataFrame:
    """KL(a || b) of the class distributions in nats, over the classes of either side."""
    ca = a.groupBy(label).agg(F.count(F.lit(1)).alias("na"))
    cb = b.groupBy(label).agg(F.count(F.lit(1)).alias("nb"))
    both = ca.join(cb, label, "full").fillna(0, ["na", "nb"])  # K rows from here on
    total = Window.partitionBy()
    p = F.col("na") / F.sum("na").over(total) + smoothing
    q = F.col("nb") / F.sum("nb").over(total) + smoothing
    smooth = both.select(p.alias("p"), q.alias("q"))
    p, q = F.col("p") / F.sum("p").over(total), F.col("q") / F.sum("q").over(total)
    return smooth.select((p * F.log(p / q)).alias("t")).agg(
        F.count(F.lit(1)).alias("n_classes"), F.round(F.sum("t"), 6).alias("kl")
    )


def order_audit(
    df: DataFrame, label: str, order: Sequence[str], n_classes: int, sorted_below: float
) -> DataFrame:
    """How often the label changes between neighbours in send order, against random order.

    The table is range-partitioned by the order, so each task compares neighbours within its
    own range; only one row per range (its first and last label) is put side by side to count
    the changes across range borders. Cutting by rows, not by time, keeps a burst from landing
    in one task.
    """
    ranged = (
        df.select(*order, label)
        .repartitionByRange(*order)
        .withColumn("_part", F.spark_partition_id())
    )
    inside = Window.partitionBy("_part").orderBy(*order)
    changed = F.coalesce(F.col(label) != F.lag(label).over(inside), F.lit(False))
    parts = ranged.withColumn("_changed", changed).groupBy("_part").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if("_changed").alias("inner"),
        F.min_by(label, F.struct(*order)).alias("first"),
        F.max_by(label, F.struct(*order)).alias("last"),
    )
    # One row per shuffle partition.
    border = F.coalesce(F.col("first") != F.lag("last").over(Window.orderBy("_part")), F.lit(False))
    total = parts.withColumn("_border", border).agg(
        F.sum("n").alias("n_rows"),
        (F.sum("inner") + F.count_if("_border")).alias("transitions"),
    )
    expected = F.col("n_rows") * (1 - 1 / n_classes)
    return total.select(
        "n_rows",
        "transitions",
        F.round(expected, 6).alias("expected_random"),
        F.when(F.col("transitions") < sorted_below * expected, "sorted_by_class")
        .otherwise("shuffled")
        .alias("verdict"),
    )


def batch_profile(df: DataFrame, batch: str, y: str, pred: str) -> DataFrame:
    """Rows, distinct true classes and accuracy of every batch."""
    return df.groupBy(batch).agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.countDistinct(y).alias("n_classes"),
        F.round(F.avg(is_correct(y, pred).cast("double")), 6).alias("accuracy"),
    )


def batch_summary(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.round(F.avg("n_classes"), 6).alias("mean_classes"),
        F.min("accuracy").alias("min_accuracy"),
        F.max("accuracy").alias("max_accuracy"),
    )


def same_rows(before: DataFrame, after: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Whether `after` is a reordering of `before`: each row covered exactly once.

    Both sides are counted in one aggregate instead of two set differences.
    """
    sides = before.select(*columns, F.lit(1).alias("b"), F.lit(0).alias("a")).unionByName(
        after.select(*columns, F.lit(0).alias("b"), F.lit(1).alias("a"))
    )
    per_row = sides.groupBy(*columns).agg(F.sum("b").alias("b"), F.sum("a").alias("a"))
    out = per_row.agg(
        F.sum("b").alias("n_before"),
        F.sum("a").alias("n_after"),
        F.count_if(F.col("b") > F.col("a")).alias("n_lost"),
        F.count_if(F.col("a") > F.col("b")).alias("n_gained"),
        F.count_if(F.col("a") > 1).alias("n_repeated"),
    )
    ok = (F.col("n_lost") == 0) & (F.col("n_gained") == 0)
    return out.withColumn("same", ok)


def probe_verdict(
    truth: DataFrame, items: DataFrame, vocabulary: DataFrame, min_correct: int
) -> DataFrame:
    """Score a small probe run before paying for a full one.

    `truth`: `id, intent`. `items`: one row per reply item, `id, intent`, null where the item
    lacked the key. Verdict order: hallucinated names, then format issues, then accuracy.
    """
    named = vocabulary.select(F.col("intent").alias("pred"), F.lit(True).alias("known"))
    answers = items.select("id", F.trim("intent").alias("pred"))
    malformed = F.col("id").isNull() | F.col("pred").isNull()
    scored = (
        answers.join(truth.select("id", F.col("intent").alias("true")), "id", "left")
        .join(named, "pred", "left")
        .agg(
            F.count(F.lit(1)).alias("n_items"),
            F.count_if(malformed).alias("n_malformed"),
            F.count_if(~malformed & F.col("true").isNull()).alias("n_unmatched"),
            F.count_if(F.col("true").isNotNull() & F.col("pred").isNotNull() & F.col("known").isNull())
            .alias("n_hallucinated"),
            F.count_if(F.col("known") & (F.col("pred") == F.col("true"))).alias("n_correct"),
        )
    )
    expected = truth.agg(F.count(F.lit(1)).alias("n_expected"))
    one = F.lit(1)
    wide = scored.withColumn("_one", one).join(F.broadcast(expected.withColumn("_one", one)), "_one")
    issues = F.col("n_malformed") + F.when(F.col("n_items") != F.col("n_expected"), 1).otherwise(0)
    return wide.withColumn("n_issues", issues.cast("bigint")).select(
        "n_expected", "n_items", "n_correct", "n_hallucinated", "n_unmatched", "n_issues",
        F.when(
            (F.col("n_correct") >= min_correct) & (F.col("n_hallucinated") == 0)
            & (F.col("n_issues") == 0), "pass")
        .when(F.col("n_hallucinated") > 0, "fail_hallucinated")
        .when(F.col("n_issues") > 0, "warn_format")
        .otherwise("warn_accuracy")
        .alias("verdict"),
    )
