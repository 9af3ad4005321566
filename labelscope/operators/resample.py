"""Bootstrap intervals, permutation tests and the crossover interval.

Resampling rows one by one costs replicates x rows. The scores only see how many rows fall in
each cell (truth, prediction of each system), so rows are first collapsed to cells and the
draws are made on the cell counts: a multinomial over cells is the same as resampling rows, a
binomial(count, 1/2) per cell the same as swapping rows.

Cells are ordered by a hash of their contents, and the hash's bits are a fixed binary tree over
them. A replicate's rows go down that tree: at a node with cells on both sides a binomial says
how many go left, drawn from a generator of the seed, the node and the block of replicates.
However a tree is cut into tasks, each can so follow the path to its own leaf, and a result
depends on the data, the seed and the replicate only: it is the same with one task or with a
thousand. Tests with many cells are cut into more leaves, so no task holds many more than
`LEAF_CELLS`. Only counts per class leave a task.

The forms named `by_hash` draw per row from an md5 instead. They do more work, but their draws
are the same on any engine.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence
from functools import reduce
from hashlib import md5
from math import ceil, exp, log2

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions.ordering import order_hash
from labelscope.functions.scoring import MISSING, f1, interval_verdict, or_missing
from labelscope.operators.ensemble import multiset_counts, multiset_votes
from labelscope.session import scratch_dir, ship_package

LEAF_CELLS = 2_048  # cells of a test that a task holds, about
BLOCK_REPLICATES = 500  # replicates drawn together; part of what seeds a draw
SWAPS_PER_HASH = 32  # one hex digit decides one swap
WEIGHTS_PER_HASH = 4  # eight hex digits make one weight


# --- on cells ----------------------------------------------------------------------------


def outcome_cells(df: DataFrame, y: str, preds: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """`keys, y, preds..., n`: rows collapsed to distinct outcomes."""
    cols = [or_missing(p).cast("bigint").alias(p) for p in preds]
    return df.groupBy(*keys, F.col(y).cast("bigint").alias("y"), *cols).agg(F.count(F.lit(1)).alias("n"))


def _class_sums(index: np.ndarray, n_classes: int):
    """A function from weights (replicates x cells) to their sums per class."""
    inside = np.flatnonzero((index >= 0) & (index < n_classes))
    order = inside[np.argsort(index[inside], kind="stable")]
    labels, starts = np.unique(index[order], return_index=True)

    def sums(w: np.ndarray) -> np.ndarray:
        out = np.zeros((len(w), n_classes), dtype=np.int64)
        if len(order):
            out[:, labels] = np.add.reduceat(w[:, order], starts, axis=1)
        return out

    return sums


def _replicates(cells: DataFrame, n: int, keys: Sequence[str]) -> DataFrame:
    """`keys, rep`: the same n replicates for every group of cells."""
    each = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(n - 1).cast("bigint")))
    return cells.select(*keys).distinct().select(*keys, each.alias("rep"))


def _left_of(start: list[int], depth: int, prefix: int, total: np.ndarray, left: int, right: int) -> np.ndarray:
    """How many of each replicate's rows at a node go to its left side."""
    if not left or not right:
        return total if left else np.zeros_like(total)
    return np.random.default_rng([*start, depth, prefix]).binomial(total, left / (left + right))


def _down(start: list[int], leaves: np.ndarray, held: np.ndarray, depth: int, own: int, n: int) -> np.ndarray:
    """Rows that reach a leaf in each of n replicates. Leaves are the nodes at `depth`."""
    total = np.full(n, int(held.sum()), dtype=np.int64)
    for level in range(depth):
        shift = depth - level
        prefix, below = own >> shift, leaves >> (shift - 1)
        left, right = int(held[below == 2 * prefix].sum()), int(held[below == 2 * prefix + 1].sum())
        to_left = _left_of(start, level, prefix, total, left, right)
        total = total - to_left if (own >> (shift - 1)) & 1 else to_left
    return total


def _spread(start: list[int], h: np.ndarray, n: np.ndarray, depth: int, total: np.ndarray) -> np.ndarray:
    """Replicates x cells: the rows of a leaf handed down to its cells, which are sorted by `h`."""
    out = np.zeros((len(total), len(h)), dtype=np.int64)
    before = np.concatenate(([0], np.cumsum(n)))
    waiting = [(0, len(h), depth, total)]
    while waiting:
        first, last, level, rows = waiting.pop()
        if last - first == 1:
            out[:, first] = rows
            continue
        prefix = int(h[first]) >> (64 - level)
        if level < 64:
            middle = first + int(np.searchsorted(h[first:last], np.uint64((2 * prefix + 1) << (63 - level))))
        else:  # equal hashes: the first against the rest
            middle = first + 1
        left, right = int(before[middle] - before[first]), int(before[last] - before[middle])
        to_left = _left_of(start, level, prefix if level < 64 else (prefix << 20) + last - first, rows, left, right)
        if middle > first:
            waiting.append((first, middle, min(level + 1, 64), to_left))
        if middle < last:
            waiting.append((middle, last, min(level + 1, 64), rows - to_left))
    return out


def resample_cells(
    cells: DataFrame, systems: Sequence[str], n_classes: int, reps: DataFrame, seed: int,
    mode: str = "bootstrap", observed: bool = False, keys: Sequence[str] = ("multiset",), leaf_cells: int = LEAF_CELLS,
) -> DataFrame:
    """`keys, rep, <system>...`: macro-F1 of each system in each replicate, to 12 digits.

    `cells` are grouped by `keys`, and `reps` says which replicates each group takes. `mode` is
    `bootstrap` (multinomial over cells) or `swap` (two systems, binomial swaps).
    """
    systems, keys = list(systems), list(keys)
    ship_package(cells.sparkSession)
    cells = cells.withColumn("h", F.xxhash64("y", *systems))
    sizes = cells.groupBy(*keys).agg(F.count(F.lit(1)).alias("c")).agg(F.max("c").alias("most"), F.sum("c").alias("all")).first()
    depth = max(0, ceil(log2(max(1, sizes["most"] or 0) / leaf_cells)))
    leaf = (F.shiftrightunsigned("h", 64 - depth) if depth else F.lit(0)).cast("int")
    cells = cells.withColumn("leaf", leaf)
    # Rows of each leaf that holds any; as many numbers as leaves, which their cells bound.
    weights = cells.groupBy(*keys, "leaf").agg(F.sum("n").alias("n")).groupBy(*keys).agg(
        F.array_sort(F.collect_list(F.struct("leaf", "n"))).alias("leaves"))
    blocks = reps.groupBy(*keys).agg(F.array_sort(F.collect_list("rep")).alias("all")).select(
        *keys, F.posexplode(F.transform(
            F.sequence(F.lit(0), F.floor((F.size("all") - 1) / BLOCK_REPLICATES).cast("int")),
            lambda i: F.slice("all", i * BLOCK_REPLICATES + 1, BLOCK_REPLICATES))).alias("block", "reps"))
    tasks = blocks.join(weights, keys).select("*", F.explode("leaves.leaf").alias("leaf"))
    sums = ["true", *[f"{c}_{i}" for i in range(len(systems)) for c in ("p", "tp")]]
    kinds = [f"`{k}` {cells.schema[k].dataType.simpleString()}" for k in keys]
    schema = ", ".join([*kinds, "rep bigint", "label bigint", *[f"`{c}` bigint" for c in sums]])

    def draw(key: tuple, cell: pd.DataFrame, task: pd.DataFrame) -> pd.DataFrame:
        *group, own, _ = key
        if cell.empty or task.empty:
            return pd.DataFrame(columns=[*keys, "rep", "label", *sums])
        cell = cell.assign(h=cell["h"].to_numpy().view(np.uint64)).sort_values(["h", "y", *systems])
        y, n, h = cell["y"].to_numpy(), cell["n"].to_numpy(), cell["h"].to_numpy()
        preds = [cell[s].to_numpy() for s in systems]
        ids = np.asarray(task["reps"].iloc[0])
        start = [seed, int(ids[0])]
        if mode == "swap":  # each cell appears as it is and with the two predictions exchanged
            a, b = preds
            moved = np.zeros((len(ids), len(y)), dtype=np.int64)
            for i in np.flatnonzero(a != b):
                moved[:, i] = np.random.default_rng([*start, int(h[i])]).binomial(n[i], 0.5, len(ids))
            w = np.concatenate([n - moved, moved], axis=1)
            y, preds = np.concatenate([y, y]), [np.concatenate([a, b]), np.concatenate([b, a])]
        else:
            leaves = np.array([x["leaf"] for x in task["leaves"].iloc[0]])
            held = np.array([x["n"] for x in task["leaves"].iloc[0]])
            taken = _down(start, leaves, held, depth, int(own), len(ids))
            w = _spread(start, h, n, depth, taken)
        counts = [_class_sums(y, n_classes)]
        for p in preds:
            counts += [_class_sums(p, n_classes), _class_sums(np.where(y == p, y, MISSING), n_classes)]
        planes = np.stack([f(w) for f in counts], axis=2)
        at, label = np.nonzero(planes.any(axis=2))
        frame = pd.DataFrame(planes[at, label], columns=sums)
        return frame.assign(rep=ids[at], label=label, **dict(zip(keys, group)))[[*keys, "rep", "label", *sums]]

    on = [*keys, "leaf", "block"]
    # Few rows, much arithmetic: tasks by the draws to make, not by bytes.
    n_tasks = max(cells.sparkSession.sparkContext.defaultParallelism * 4, ceil((sizes["all"] or 0) / leaf_cells))
    spread = cells.join(blocks.select(*keys, "block"), keys).select(*[F.col(c).alias(c) for c in [*on, "y", *systems, "n", "h"]])
    asked = tasks.select(*[F.col(c).alias(f"t_{c}") for c in on], "reps", "leaves")
    other = [f"t_{c}" for c in on]
    drawn = spread.repartition(n_tasks, *on).groupBy(*on).cogroup(
        asked.repartition(n_tasks, *other).groupBy(*other)).applyInPandas(draw, schema)
    by_class = drawn.groupBy(*keys, "rep", "label").agg(*[F.sum(c).alias(c) for c in sums])

    def macro(i: int) -> Column:
        score = f1(f"tp_{i}", f"p_{i}", "true")
        seen = F.col(f"p_{i}") + F.col("true") > 0
        return F.coalesce(F.avg(F.when(seen, score)), F.lit(0.0)) if observed else F.sum(score) / n_classes

    return by_class.groupBy(*keys, "rep").agg(*[F.round(macro(i), 12).alias(s) for i, s in enumerate(systems)])


def difference_summary(reps: DataFrame, observed: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Observed difference, mean over replicates and the 95% interval."""
    diff = F.col(a) - F.col(b)
    stats = reps.agg(
        F.round(F.avg(diff), 6).alias("bootstrap_mean"),
        F.percentile(diff, F.array(F.lit(0.025), F.lit(0.975))).alias("q"),
        F.count(F.lit(1)).alias("n_replicates"),
    )
    one = F.lit(1)
    return (
        observed.withColumn("_one", one)
        .join(stats.withColumn("_one", one), "_one")  # one row each
        .select(
            "observed_diff", "bootstrap_mean",
            F.round(F.col("q")[0], 6).alias("ci_lower"), F.round(F.col("q")[1], 6).alias("ci_upper"),
            "n_replicates",
        )
    )


def observed_scores(
    cells: DataFrame, systems: Sequence[str], n_classes: int, keys: Sequence[str] = (), observed: bool = False
) -> DataFrame:
    """`keys, <system>...`: macro-F1 of each system from outcome cells."""
    sides = F.array(*[
        F.struct(F.lit(s).alias("system"), F.col(s).alias("label"), F.lit(0).cast("bigint").alias("true"),
                 F.col("n").alias("predicted"), F.when(F.col(s) == F.col("y"), F.col("n")).otherwise(F.lit(0)).alias("tp"))
        for s in systems
    ] + [
        F.struct(F.lit(s).alias("system"), F.col("y").alias("label"), F.col("n").alias("true"),
                 F.lit(0).cast("bigint").alias("predicted"), F.lit(0).cast("bigint").alias("tp"))
        for s in systems
    ])
    by_class = (
        cells.select(*keys, F.inline(sides)).filter(F.col("label") > MISSING)
        .groupBy(*keys, "system", "label")
        .agg(F.sum("tp").alias("tp"), F.sum("predicted").alias("p"), F.sum("true").alias("t"))
        .withColumn("f1", f1("tp", "p", "t"))
    )
    mean = lambda s: (
        F.avg(F.when(F.col("system") == s, F.col("f1"))) if observed
        else F.coalesce(F.sum(F.when(F.col("system") == s, F.col("f1"))), F.lit(0.0)) / n_classes
    )
    return by_class.groupBy(*keys).agg(*[mean(s).alias(s) for s in systems])


def _observed_diff(cells: DataFrame, n_classes: int, observed: bool) -> DataFrame:
    both = observed_scores(cells, ("a", "b"), n_classes, observed=observed)
    return both.select(F.round(F.col("a") - F.col("b"), 6).alias("observed_diff"))


def paired_bootstrap(
    df: DataFrame, y: str, a: str, b: str, n_classes: int, replicates: int = 5000, seed: int = 42,
    observed: bool = True,
) -> DataFrame:
    """Interval on the macro-F1 difference a - b, resampling rows.

    The mean is over the classes that occur in a replicate (`observed=False`: over [0, K)).
    """
    renamed = df.select(F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b"))
    cells = outcome_cells(renamed, "y", ("a", "b")).withColumn("multiset", F.lit(0))
    reps = resample_cells(
        cells, ("a", "b"), n_classes, _replicates(cells, replicates, ["multiset"]), seed, observed=observed)
    return difference_summary(reps, _observed_diff(cells, n_classes, observed))


def paired_permutation(
    df: DataFrame, y: str, a: str, b: str, n_classes: int, replicates: int = 10_000, seed: int = 42,
    keys: Sequence[str] = (),
) -> DataFrame:
    """Two-sided approximate randomisation test on the macro-F1 difference a - b, one for each
    value of `keys`."""
    renamed = df.select(*keys, F.col(y).alias("y"), F.col(a).alias("a"), F.col(b).alias("b"))
    cells = outcome_cells(renamed, "y", ("a", "b"), keys)
    groups = list(keys) or ["multiset"]
    sets = cells if keys else cells.withColumn("multiset", F.lit(0))
    reps = resample_cells(sets, ("a", "b"), n_classes, _replicates(sets, replicates, groups), seed, "swap", keys=groups)
    observed = observed_scores(cells, ("a", "b"), n_classes, keys).select(*keys, (F.col("a") - F.col("b")).alias("d"))
    return p_values(reps.select(*keys, "rep", (F.col("a") - F.col("b")).alias("diff")), observed, keys)


def p_values(reps: DataFrame, observed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """(hits + 1) / (replicates + 1), where a hit is a difference at least as large as observed.

    Both are rounded to 12 digits first: equal counts must compare as equal whatever order
    their class scores were added in.
    """
    on = list(keys) or ["_one"]
    if not keys:
        reps, observed = reps.withColumn("_one", F.lit(1)), observed.withColumn("_one", F.lit(1))
    hit = F.abs(F.round("diff", 12)) >= F.abs(F.round("d", 12))
    # One observed row per test: the replicate table is reduced before it is shuffled.
    return reps.join(F.broadcast(observed), on).groupBy(*on).agg(
        F.round(F.first("d"), 6).alias("observed_diff"),
        F.round((F.count_if(hit) + 1) / (F.count(F.lit(1)) + 1), 6).alias("p_value"),
        F.count(F.lit(1)).alias("n_replicates"),
    ).select(*keys, "observed_diff", "p_value", "n_replicates")


# --- over seeds and rows -----------------------------------------------------------------


def _budget_columns(budgets: Sequence[int]) -> list[str]:
    return [f"n{b}" for b in sorted(budgets)]


def seed_draws(seeds: Sequence[int], replicates: int, seed: int, resample_seeds: bool) -> tuple[list, list]:
    """The multisets of seeds that are drawn, `(number, times of each seed)`, and the number each
    replicate drew, `(rep, number)`.

    Each draw of each replicate picks a seed by an md5. Both lists are as long as there are
    replicates at most, however many multisets the seeds allow.
    """
    size = len(seeds)
    if not resample_seeds:
        return [(0, (1,) * size)], [(r, 0) for r in range(replicates)]
    numbers: dict[tuple[int, ...], int] = {}
    drawn = []
    for r in range(replicates):
        picks = Counter(int(md5(f"{seed}:draw{j}:{r}".encode()).hexdigest()[:8], 16) % size for j in range(size))
        drawn.append((r, numbers.setdefault(tuple(picks[s] for s in range(size)), len(numbers))))
    return [(number, times) for times, number in numbers.items()], drawn


def multiset_cells(
    probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int, sets: list
) -> DataFrame:
    """Outcome cells `multiset, y, base, n<budget>..., n` for the given seed multisets.

    `probs`: row_id, y, the baseline's prediction, training_size, seed, probs.
    """
    renamed = probs.withColumn("base", or_missing(base).cast("bigint"))
    return multiset_counts(renamed, sets, n_classes, sorted(budgets), seeds, by=("y", "base"))


def seed_row_replicates(
    probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int,
    replicates: int, seed: int, resample_seeds: bool = True,
) -> DataFrame:
    """`rep, base, n<budget>...`: scores of the baseline and of every budget's ensemble.

    One draw of seeds and rows per replicate serves all budgets, so a replicate's curve is
    consistent in itself.
    """
    return _replicates_and_observed(probs, base, budgets, seeds, n_classes, replicates, seed, resample_seeds)[0]


def _replicates_and_observed(
    probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int,
    replicates: int, seed: int, resample_seeds: bool, observed: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """`seed_row_replicates`, and with `observed` the scores over all rows and seeds as one more multiset."""
    sets, drawn = seed_draws(seeds, replicates, seed, resample_seeds)
    each = (1,) * len(seeds)
    numbers = {times: number for number, times in sets}
    if observed and each not in numbers:
        sets = [*sets, (len(sets), each)]
    whole = numbers.get(each, len(numbers))
    spark, systems = probs.sparkSession, ["base", *_budget_columns(budgets)]
    # The votes behind the cells are the costly part; they are taken once.
    path = scratch_dir(spark, "outcome-cells")
    multiset_cells(probs, base, budgets, seeds, n_classes, sets).write.parquet(path)
    cells = spark.read.parquet(path)
    reps = spark.createDataFrame(drawn, "rep bigint, multiset int")
    used = cells.filter(F.col("multiset") < len(numbers))
    return (resample_cells(used, systems, n_classes, reps, seed),
            observed_scores(cells.filter(F.col("multiset") == whole), systems, n_classes))


def hierarchical_bootstrap(
    probs: DataFrame, base: str, budget: int, seeds: Sequence[int], n_classes: int,
    replicates: int = 2000, seed: int = 42, resample_seeds: bool = True,
) -> DataFrame:
    """Interval on ensemble minus baseline at one budget, over seeds and rows (or rows only)."""
    one = probs.filter(F.col("training_size") == budget)
    reps, both = _replicates_and_observed(one, base, [budget], seeds, n_classes, replicates, seed, resample_seeds, True)
    system = f"n{budget}"
    observed = both.select(F.round(F.col(system) - F.col("base"), 6).alias("observed_diff"))
    return difference_summary(reps, observed, system, "base").withColumn("resampled_seeds", F.lit(resample_seeds))


def gap_intervals(reps: DataFrame, budgets: Sequence[int], observed: DataFrame) -> DataFrame:
    """`training_size` and the summary of ensemble minus baseline for every budget. `observed` has
    the baseline's score and each budget's, in one row, `reps` one row a replicate."""
    columns = F.array(*[
        F.struct(F.lit(b).cast("bigint").alias("training_size"), (F.col(f"n{b}") - F.col("base")).alias("gap")) for b in sorted(budgets)])
    each = lambda df: df.select(F.inline(columns))
    stats = each(reps).groupBy("training_size").agg(
        F.avg("gap").alias("mean"), F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("n_replicates"))
    return each(observed).join(stats, "training_size").select(
        "training_size", F.round("gap", 6).alias("observed_diff"), F.round("mean", 6).alias("bootstrap_mean"),
        F.round(F.col("q")[0], 6).alias("ci_lower"), F.round(F.col("q")[1], 6).alias("ci_upper"), "n_replicates")


def observed_curve(probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int) -> DataFrame:
    """One row: scores of the baseline and of every budget's ensemble over all rows."""
    cells = multiset_cells(probs, base, budgets, seeds, n_classes, [(0, (1,) * len(seeds))])
    return observed_scores(cells, ["base", *_budget_columns(budgets)], n_classes)


def hierarchical_gaps(
    probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int,
    replicates: int = 2000, seed: int = 42, resample_seeds: bool = True,
) -> DataFrame:
    """`hierarchical_bootstrap` for all budgets in one job: a replicate's draw of seeds and rows
    serves every budget."""
    reps, observed = _replicates_and_observed(probs, base, budgets, seeds, n_classes, replicates, seed, resample_seeds, True)
    return gap_intervals(reps, budgets, observed)


def crossovers(reps: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """`rep, crossover_n`: the first budget that reaches the baseline, null if none does."""
    reached = [F.when(F.col(f"n{b}") >= F.col("base"), F.lit(b)) for b in sorted(budgets)]
    return reps.select("rep", (F.coalesce(*reached)).cast("bigint").alias("crossover_n"))


def crossover_summary(found: DataFrame, budgets: Sequence[int]) -> DataFrame:
    """Median and interval over the replicates that cross, and the share that never do."""
    n = F.col("crossover_n")
    counts = ", ".join(f"n{b}" for b in sorted(budgets))
    per_budget = [F.count_if(n == b).alias(f"n{b}") for b in sorted(budgets)]
    stats = found.agg(
        F.percentile(n, F.array(F.lit(0.5), F.lit(0.025), F.lit(0.975))).alias("q"),
        F.round(F.count_if(n.isNull()) / F.count(F.lit(1)), 4).alias("never_share"),
        F.count(F.lit(1)).alias("n_replicates"),
        *per_budget,
    )
    distribution = F.concat_ws(",", *[
        F.concat(F.lit(f"{b}:"), F.col(f"n{b}").cast("string")) for b in sorted(budgets)])
    return stats.select(
        F.floor(F.col("q")[0]).cast("bigint").alias("median_n"),
        F.floor(F.col("q")[1]).cast("bigint").alias("ci_lower_n"),
        F.floor(F.col("q")[2]).cast("bigint").alias("ci_upper_n"),
        "never_share", "n_replicates", distribution.alias("distribution"),
    )


def crossover_interval(
    probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int,
    replicates: int = 2000, seed: int = 42, resample_seeds: bool = True,
) -> DataFrame:
    """Interval on the budget at which the ensemble reaches the baseline."""
    reps = seed_row_replicates(probs, base, budgets, seeds, n_classes, replicates, seed, resample_seeds)
    return crossover_summary(crossovers(reps, budgets), budgets)


# --- per row, drawn from a hash ----------------------------------------------------------


def poisson_thresholds() -> list[int]:
    """Cumulative Poisson(1) probabilities as 32-bit integers: the weight of a row is the
    number of thresholds its 32 random bits reach."""
    out, term, cdf, k = [], exp(-1), 0.0, 0
    while True:
        cdf += term
        at = int(cdf * 2**32)
        if at >= 2**32 - 1 or (out and at == out[-1]):
            return out
        out.append(at)
        k += 1
        term /= k


def poisson_weight(digest: Column, slot: int) -> Column:
    """Poisson(1) weight from the slot-th eight hex digits of a digest."""
    u = F.conv(F.substring(digest, 8 * slot + 1, 8), 16, 10).cast("bigint")
    return reduce(lambda s, t: s + F.when(u >= t, 1).otherwise(0), poisson_thresholds(), F.lit(0)).cast("bigint")


def poisson_cells(
    df: DataFrame, cell: Sequence[str], key: str, replicates: int, seed: int, keys: Sequence[str] = ()
) -> DataFrame:
    """`keys, rep, cell..., n`: summed row weights per outcome cell and replicate.

    One md5 serves four replicates; sums are partial per task, so what is shuffled is cells x
    replicates whatever the number of rows.
    """
    blocks = -(-replicates // WEIGHTS_PER_HASH)
    weighted = (
        df.select(*keys, *cell, key, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        .withColumn("_h", order_hash(seed, "block", key))
    )
    sums = weighted.groupBy(*keys, *cell, "block").agg(
        *[F.sum(poisson_weight(F.col("_h"), j)).alias(f"w{j}") for j in range(WEIGHTS_PER_HASH)])
    slots = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"w{j}").alias("n")) for j in range(WEIGHTS_PER_HASH)])
    return (
        sums.select(*keys, *cell, "block", F.inline(slots))
        .withColumn("rep", (F.col("block") * WEIGHTS_PER_HASH + F.col("j")).cast("bigint"))
        .filter(F.col("rep") < replicates)
        .select(*keys, "rep", *cell, "n")
    )


def poisson_bootstrap(
    df: DataFrame, y: str, a: str, b: str, key: str, n_classes: int, replicates: int, seed: int,
    keys: Sequence[str] = (), observed: bool = False,
) -> DataFrame:
    """`keys, rep, a, b`: macro-F1 of both systems with Poisson(1) row weights."""
    rows = df.select(*keys, key, F.col(y).cast("bigint").alias("y"),
                     or_missing(a).cast("bigint").alias("a"), or_missing(b).cast("bigint").alias("b"))
    cells = poisson_cells(rows, ("y", "a", "b"), key, replicates, seed, keys)
    return observed_scores(cells, ("a", "b"), n_classes, [*keys, "rep"], observed)


def permutation_by_hash(
    df: DataFrame, y: str, a: str, b: str, key: str, n_classes: int, replicates: int, seed: int,
    keys: Sequence[str] = (),
) -> DataFrame:
    """The randomisation test with row swaps decided by an md5, for any number of tests at once.

    Only rows on which the systems differ can change anything, and one md5 decides 32 swaps.
    Swapped rows are counted per cell; a replicate then differs from the observed counts by
    those swaps alone, a table of classes x replicates.
    """
    rows = df.select(*keys, key, F.col(y).cast("bigint").alias("y"),
                     or_missing(a).cast("bigint").alias("a"), or_missing(b).cast("bigint").alias("b"))
    cells = outcome_cells(rows, "y", ("a", "b"), keys)
    blocks = -(-replicates // SWAPS_PER_HASH)
    differing = (
        rows.filter("a <> b")
        .select(*keys, "y", "a", "b", key, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        .withColumn("_h", order_hash(seed, "block", key))
    )
    swapped = differing.groupBy(*keys, "y", "a", "b", "block").agg(*[
        F.count_if(F.substring("_h", j + 1, 1) < "8").alias(f"s{j}") for j in range(SWAPS_PER_HASH)])
    slots = F.array(*[F.struct(F.lit(j).alias("j"), F.col(f"s{j}").alias("s")) for j in range(SWAPS_PER_HASH)])
    moved = (
        swapped.select(*keys, "y", "a", "b", "block", F.inline(slots))
        .withColumn("rep", (F.col("block") * SWAPS_PER_HASH + F.col("j")).cast("bigint"))
        .filter(F.col("rep") < replicates)
    )
    # A swap takes class a from system a and gives it class b; the other system mirrors it.
    zero = F.lit(0).cast("bigint")
    hit = lambda c: F.when(F.col("y") == F.col(c), F.col("s")).otherwise(zero)
    change = F.array(
        F.struct(F.col("a").alias("label"), (-F.col("s")).alias("dp"), (-hit("a")).alias("dtp")),
        F.struct(F.col("b").alias("label"), F.col("s").alias("dp"), hit("b").alias("dtp")),
    )
    deltas = moved.select(*keys, "rep", F.inline(change)).groupBy(*keys, "rep", "label").agg(
        F.sum("dp").alias("dp"), F.sum("dtp").alias("dtp"))
    side = lambda s: F.struct(
        F.col(s).alias("label"), zero.alias("t"),
        *[(F.col("n") if s == o else zero).alias(f"p_{o}") for o in "ab"],
        *[(F.when(F.col(s) == F.col("y"), F.col("n")).otherwise(zero) if s == o else zero).alias(f"tp_{o}") for o in "ab"])
    truth = F.struct(F.col("y").alias("label"), F.col("n").alias("t"),
                     *[zero.alias(c) for c in ("p_a", "p_b", "tp_a", "tp_b")])
    base = cells.select(*keys, F.inline(F.array(truth, side("a"), side("b")))).filter(
        F.col("label") > MISSING).groupBy(*keys, "label").agg(
        *[F.sum(c).alias(c) for c in ("t", "p_a", "p_b", "tp_a", "tp_b")])
    grid = base.select("*", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1))).alias("rep")).withColumn(
        "rep", F.col("rep").cast("bigint"))
    both = grid.join(deltas, [*keys, "rep", "label"], "left").fillna(0, ["dp", "dtp"])
    gap = (f1(F.col("tp_a") + F.col("dtp"), F.col("p_a") + F.col("dp"), "t")
           - f1(F.col("tp_b") - F.col("dtp"), F.col("p_b") - F.col("dp"), "t"))
    reps = both.groupBy(*keys, "rep").agg((F.sum(gap) / n_classes).alias("diff"))
    observed = base.groupBy(*keys).agg(
        (F.sum(f1("tp_a", "p_a", "t") - f1("tp_b", "p_b", "t")) / n_classes).alias("d"))
    return p_values(reps, observed, keys)


def seed_row_replicates_by_hash(
    probs: DataFrame, base: str, budgets: Sequence[int], seeds: Sequence[int], n_classes: int,
    replicates: int, seed: int, resample_seeds: bool = True,
) -> DataFrame:
    """`rep, base, n<budget>...` with Poisson(1) row weights and hash-drawn seeds.

    A row meets only the replicates that drew its multiset, and everything after that is a
    partial sum per (replicate, system, truth, prediction).
    """
    sets, drawn = seed_draws(seeds, replicates, seed, resample_seeds)
    draws = probs.sparkSession.createDataFrame(drawn, "rep bigint, multiset int")
    by_set = draws.groupBy("multiset").agg(F.collect_list("rep").alias("reps"))  # `replicates` numbers in all
    names = ["base", *_budget_columns(budgets)]
    voted = multiset_votes(probs, sets, n_classes, sorted(budgets), seeds, carry=("y", base))
    preds = [F.get("preds", F.lit(i)).alias(c) for i, c in enumerate(names[1:])]
    used = (
        voted.select("row_id", "y", F.col(base).alias("base"), "multiset", *preds)
        .join(F.broadcast(by_set), "multiset")
        .withColumn("rep", F.explode("reps"))
        .withColumn("_h", order_hash(seed, F.floor(F.col("rep") / WEIGHTS_PER_HASH), F.col("row_id")))
    )
    slot = F.col("rep") % WEIGHTS_PER_HASH
    digits = F.substr(F.col("_h"), (8 * slot + 1).cast("int"), F.lit(8))
    answers = F.array(*[
        F.struct(F.lit(c).alias("system"), or_missing(c).cast("bigint").alias("pred")) for c in names])
    cells = used.select("rep", "y", poisson_weight(digits, 0).alias("w"), F.inline(answers)).groupBy(
        "rep", "system", "y", "pred").agg(F.sum("w").alias("n"))
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), zero.alias("p"), F.col("n").alias("t")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), F.col("n").alias("p"), zero.alias("t")))
    by_class = cells.select("rep", "system", F.inline(sides)).filter(F.col("label") > MISSING).groupBy(
        "rep", "system", "label").agg(F.sum("tp").alias("tp"), F.sum("p").alias("p"), F.sum("t").alias("t"))
    score = F.sum(f1("tp", "p", "t")) / n_classes
    return by_class.groupBy("rep", "system").agg(score.alias("f1")).groupBy("rep").pivot("system", names).agg(F.first("f1"))


def verdict(summary: DataFrame) -> DataFrame:
    """Adds which system the interval favours."""
    return summary.withColumn("verdict", interval_verdict("ci_lower", "ci_upper"))
