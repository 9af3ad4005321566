"""Stratified carves, nested budget subsets, leakage and overlap audits."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.ordering import order_hash, rank_in_group


def class_quotas(counts: DataFrame, label: str, sizes: Sequence[int]) -> DataFrame:
    """`label, upto_0, upto_1, ...`: where each of several successive carves ends in a class.

    `counts` is `label, c`, one row per class, so the windows below run over K rows. Each
    carve splits its rows over what earlier ones left, by largest remainder; ties go to the
    lower label. A carve larger than what is left takes all of it.
    """
    everything = Window.partitionBy()
    by_rest = Window.orderBy(F.desc("_rest"), label)
    out, used = counts.withColumn("upto", F.lit(0).cast("bigint")), []
    for i, m in enumerate(sizes):
        left = F.col("c") - F.col("upto")
        total = F.sum(left).over(everything)
        shares = out.withColumn("_left", left).withColumn("_m", F.least(F.lit(m), total)).withColumn(
            "_total", F.greatest(total, F.lit(1)))
        shares = shares.withColumn("_whole", F.expr("(_m * _left) div _total")).withColumn(
            "_rest", F.expr("(_m * _left) % _total"))
        extra = F.when(
            F.row_number().over(by_rest) <= F.col("_m") - F.sum("_whole").over(everything), 1).otherwise(0)
        used.append(f"upto_{i}")
        out = shares.withColumn("upto", (F.col("upto") + F.col("_whole") + extra).cast("bigint")).withColumn(
            used[-1], F.col("upto")).select(label, "c", "upto", *used)
    return out.select(label, *used)


def carve_splits(
    df: DataFrame, sizes: dict[str, int], label: str, key: str, seed: int, rest: str = "pool"
) -> DataFrame:
    """The rows with a `split` column: successive stratified carves, and the rest as the pool.

    Each carve is what a single one would take from the rows earlier ones left. One hash order
    serves them all, so a carve is a range of ranks within each class and all of them take one
    pass; only carved rows are shuffled.
    """
    upto = [f"upto_{i}" for i in range(len(sizes))]

    def limits(counts: DataFrame) -> DataFrame:
        quotas = class_quotas(counts, label, list(sizes.values()))
        return quotas.withColumn("_limit", F.col(upto[-1]))

    carved = _ranked_carve(df, label, key, seed, limits, upto)
    name = F.coalesce(*[F.when(F.col("_rank") <= F.col(u), s) for u, s in zip(upto, sizes)])
    tags = carved.select(key, name.alias("split"))
    return df.join(tags, key, "left").withColumn("split", F.coalesce("split", F.lit(rest))).select(
        *df.columns, "split")


def _ranked_carve(df: DataFrame, label: str, key: str, seed: int, limits, upto: Sequence[str]) -> DataFrame:
    """Rows up to their class limit with `_rank` and the class's carve ends."""
    # The classes are counted once; their ends come along with the ranks.
    ends = [] if len(upto) == 1 else list(upto)
    ranked = rank_in_group(df.select(key, label), [label], key, seed, out="_rank", limits=limits, carry=ends)
    return ranked if ends else ranked.withColumn(upto[0], F.col("_rank"))


def stratified_carve(df: DataFrame, m: int, label: str, key: str, seed: int) -> DataFrame:
    """Exactly `m` rows (all of them if there are fewer), in proportion to the classes."""
    limits = lambda counts: class_quotas(counts, label, [m]).withColumnRenamed("upto_0", "_limit")
    return rank_in_group(df, [label], key, seed, out="_rank", limits=limits).drop("_rank")


def round_robin(
    df: DataFrame,
    label: str,
    key: str,
    seed: int | str,
    label_order: str = "shuffled",
    limit: int | None = None,
    n_groups: int | None = None,
    out: str = "pos",
) -> DataFrame:
    """Number rows so that every prefix is as balanced over classes as it can be.

    Each class is shuffled, then classes take turns: first every class's rank 1, then every
    rank 2, and so on, in a shuffled class order (or by label id, `label_order="label"`).
    Prefixes nest. `seed` is a number or the name of a seed column, in which case every seed
    is numbered on its own.

    The place of rank r in class l follows from the class counts alone, so nothing is sorted
    globally: sum_j min(c_j, r-1) rows come from earlier rounds, and the classes of this round
    not after l fill the rest. A row's place is never before its rank, so with `limit` only
    ranks up to it are shuffled. `n_groups` bounds the classes (times seeds) for that step.
    """
    per = [seed] if isinstance(seed, str) else []
    seed_col = F.col(seed) if per else F.lit(str(seed))
    counts = df.groupBy(*per, label).agg(F.count(F.lit(1)).alias("c"))
    if label_order == "shuffled":
        turn = Window.partitionBy(*per).orderBy(order_hash(seed_col, F.col(label)), label)
    else:
        turn = Window.partitionBy(*per).orderBy(label)
    # K rows per seed, each carrying the K class sizes: bounded by the vocabulary.
    classes = counts.withColumn("o", F.row_number().over(turn)).select(
        *per, label, "o",
        F.collect_list(F.struct("c", "o")).over(Window.partitionBy(*per)).alias("classes"),
    )
    ranked = rank_in_group(
        df, [*per, label], key, seed_col, out="_r", limit=limit, n_groups=n_groups
    )
    earlier = F.aggregate(
        "classes", F.lit(0).cast("bigint"), lambda a, x: a + F.least(x["c"], F.col("_r") - 1)
    )
    this_round = F.size(
        F.filter("classes", lambda x: (x["c"] >= F.col("_r")) & (x["o"] <= F.col("o")))
    )
    placed = ranked.join(classes, [*per, label]).withColumn(
        out, (earlier + this_round).cast("bigint")
    )
    if limit is not None:
        placed = placed.filter(F.col(out) <= limit)
    return placed.select(*df.columns, out)


def balanced_take(
    df: DataFrame, n: int, label: str, key: str, seed: int, n_classes: int | None = None
) -> DataFrame:
    """`n` rows spread as evenly over classes as the pool allows, with a shuffled `order_key`.

    Classes take turns in label order, so a last partial round favours low labels.
    """
    taken = round_robin(df, label, key, seed, "label", limit=n, n_groups=n_classes)
    return taken.withColumn("order_key", order_hash(seed, F.lit("order"), F.col(key)))


def subset_grid(
    pool: DataFrame,
    label: str,
    key: str,
    sizes: Sequence[int],
    seeds: Sequence[int],
    n_classes: int | None = None,
) -> DataFrame:
    """`training_size, seed, pos` and the pool's columns for every budget that fits the pool.

    The pool is numbered once per seed up to the largest budget that fits; a row then belongs
    to every budget not below its place. Budgets larger than the pool are left out.
    """
    n_pool = pool.count()
    fitting = [n for n in sorted(sizes) if n <= n_pool]
    if not fitting:
        raise ValueError(f"no budget of {list(sizes)} fits a pool of {n_pool} rows")
    seeded = pool.withColumn("seed", F.explode(F.array(*[F.lit(s) for s in seeds])))
    ordered = round_robin(seeded, label, key, "seed", limit=fitting[-1],
                          n_groups=n_classes and n_classes * len(seeds))
    budgets = F.filter(F.array(*[F.lit(n) for n in fitting]), lambda n: n >= F.col("pos"))
    return ordered.withColumn("training_size", F.explode(budgets))


def class_coverage(grid: DataFrame, label: str, n_classes: int, seeds: Sequence[int]) -> DataFrame:
    """Classes present per budget, one column per seed, and the most any seed misses."""
    present = grid.groupBy("training_size", "seed").agg(F.countDistinct(label).alias("present"))
    wide = present.groupBy("training_size").pivot("seed", list(seeds)).agg(F.first("present"))
    named = [F.col(str(s)).alias(f"seed_{s}") for s in seeds]
    most_missing = F.lit(n_classes) - F.least(*[F.col(str(s)) for s in seeds]) if len(seeds) > 1 \
        else F.lit(n_classes) - F.col(str(seeds[0]))
    return wide.select("training_size", *named, most_missing.cast("bigint").alias("most_missing"))


def drop_leaked(train: DataFrame, test: DataFrame, text: str = "text") -> DataFrame:
    """Training rows whose text does not occur in the test side. The test side is never edited.

    Joined on a 64-bit hash as well as the text, so sorting and most comparing is on numbers;
    the test side is reduced to distinct texts first.
    """
    seen = test.select(F.xxhash64(text).alias("_x"), F.col(text)).distinct()
    return (
        train.withColumn("_x", F.xxhash64(text)).join(seen, ["_x", text], "left_anti").drop("_x")
        .select(*train.columns)
    )


def carve_by_text(
    df: DataFrame, m: int, label: str, key: str, seed: int, text: str = "text"
) -> tuple[DataFrame, DataFrame]:
    """(carved, rest), where the rest holds no copy of a carved text."""
    carved = stratified_carve(df, m, label, key, seed)
    return carved, drop_leaked(df, carved, text)


def split_overlaps(rows: DataFrame, splits: Sequence[str], text: str = "text") -> DataFrame:
    """Shared distinct texts for every pair of splits, from one shuffle by text.

    A text's splits are folded into at most one flag per split, so a text copied a billion
    times is still one partial row per task.
    """
    flags = [F.max(F.col("split") == s).alias(f"_{i}") for i, s in enumerate(splits)]
    by_text = rows.groupBy(F.xxhash64(text).alias("_x"), F.col(text)).agg(*flags)
    pairs = list(combinations(range(len(splits)), 2))
    shared = by_text.agg(
        *[F.count_if(F.col(f"_{i}") & F.col(f"_{j}")).alias(f"p{i}_{j}") for i, j in pairs]
    )
    stacked = ", ".join(f"'{splits[i]}', '{splits[j]}', p{i}_{j}" for i, j in pairs)
    return shared.selectExpr(f"stack({len(pairs)}, {stacked}) as (split_a, split_b, shared)") \
        .withColumn("verdict", F.when(F.col("shared") > 0, "leak").otherwise("ok"))


def seed_independence(
    grid: DataFrame, pool_texts: DataFrame, n_seeds: int, text: str = "text"
) -> DataFrame:
    """Per budget: texts all seeds share, mean pairwise overlap, and what chance would give.

    A text drawn by m of the S seeds is shared by m(m-1)/2 pairs, so counts are enough and no
    sets are built. `pool_texts` holds the texts the seeds were drawn from.
    """
    pairs = n_seeds * (n_seeds - 1) // 2
    pool = pool_texts.select(text).distinct().agg(F.count(F.lit(1)).alias("pool"))
    drawn = grid.groupBy("training_size", text, "seed").agg(F.lit(1).alias("one"))
    per_text = drawn.groupBy("training_size", text).agg(F.count(F.lit(1)).alias("m"))
    per_size = per_text.groupBy("training_size").agg(
        F.count_if(F.col("m") == n_seeds).alias("shared_by_all"),
        F.sum(F.expr("m * (m - 1) div 2")).alias("shared_pairs"),
    )
    mean = F.col("shared_pairs") / pairs
    return (
        per_size.withColumn("_one", F.lit(1))
        .join(F.broadcast(pool.withColumn("_one", F.lit(1))), "_one")  # one row
        .select(
            "training_size",
            "shared_by_all",
            F.round(mean, 6).alias("mean_pairwise"),
            F.round(F.col("training_size") * F.col("training_size") / F.col("pool"), 6)
            .alias("expected_random"),
            (mean / F.col("training_size") > 0.9).alias("near_identical"),
        )
    )


def distinct_pool(grid: DataFrame, key: str, text: str = "text") -> DataFrame:
    """One row per distinct text over a grid: the one with the smallest key."""
    rest = [c for c in grid.columns if c != text]
    kept = F.min_by(F.struct(*rest), F.col(key))
    return grid.groupBy(text).agg(kept.alias("_r")).select("_r.*", text).select(*grid.columns)
