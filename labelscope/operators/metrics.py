"""Scores from confusion counts.

Every score starts from `confusion`: one shuffle that leaves at most (K+1)^2 rows per run,
whatever the number of predictions. Everything after it is arithmetic on that small table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from labelscope.functions.scoring import MISSING, f1, is_correct, label_budget, or_missing

ONE = "_one"


def confusion(df: DataFrame, y: str, pred: str, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, y, pred, n`; a missing prediction counts under the sentinel."""
    return df.groupBy(
        *keys, F.col(y).cast("bigint").alias("y"), or_missing(pred).cast("bigint").alias("pred")
    ).agg(F.count(F.lit(1)).alias("n"))


def _class_rows(cells: DataFrame, keys: Sequence[str] = (), kept: Column | None = None) -> DataFrame:
    """`keys, label, tp, predicted, true[, predicted_kept]` per class that occurs, the sentinel
    included. `predicted_kept` counts predictions on rows whose true class passes `kept`."""
    hit = F.when(F.col("y") == F.col("pred"), F.col("n")).otherwise(F.lit(0))
    zero = F.lit(0).cast("bigint")
    some = F.when(kept, F.col("n")).otherwise(zero) if kept is not None else zero
    sides = F.array(
        F.struct(F.col("y").alias("label"), hit.alias("tp"), zero.alias("predicted"),
                 F.col("n").alias("true"), zero.alias("predicted_kept")),
        F.struct(F.col("pred").alias("label"), zero.alias("tp"), F.col("n").alias("predicted"),
                 zero.alias("true"), some.alias("predicted_kept")),
    )
    sums = ["tp", "predicted", "true"] + (["predicted_kept"] if kept is not None else [])
    return cells.select(*keys, F.inline(sides)).groupBy(*keys, "label").agg(*[F.sum(c).alias(c) for c in sums])


def class_counts(cells: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, label, tp, predicted, true` for the classes that occur (sentinel left out)."""
    return _class_rows(cells, keys).filter(F.col("label") > MISSING)


def per_class(cells: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, label, tp, predicted, true, f1` for every class of [0, K), absent ones at 0.

    A run's classes are gathered into one map of at most K entries and read back for every
    label, so the cells are computed once.
    """
    entry = F.struct("label", F.struct("tp", "predicted", "true"))
    found = class_counts(cells, keys).groupBy(*keys).agg(F.map_from_entries(F.collect_list(entry)).alias("_m"))
    labels = F.explode(F.sequence(F.lit(0), F.lit(n_classes - 1))).alias("label")
    each = found.select("*", labels).withColumn("label", F.col("label").cast("bigint"))
    stats = F.try_element_at("_m", F.col("label"))
    return each.select(
        *keys, "label", *[F.coalesce(stats[c], F.lit(0)).alias(c) for c in ("tp", "predicted", "true")]
    ).withColumn("f1", f1("tp", "predicted", "true"))


def macro_f1(
    cells: DataFrame, n_classes: int | None, keys: Sequence[str] = (), out: str = "macro_f1"
) -> DataFrame:
    """Mean F1 per run. Over [0, K) an absent class scores 0 and stays in the denominator;
    with `n_classes=None` the mean is over the classes seen in truth or predictions. Rounded to 12
    digits only: equal counts compare as equal whatever order their F1 scores were added in."""
    scored = class_counts(cells, keys).withColumn("f1", f1("tp", "predicted", "true"))
    if n_classes is None:
        mean = F.avg("f1")
    else:
        mean = F.coalesce(F.sum(F.when(F.col("label") < n_classes, F.col("f1"))), F.lit(0.0)) / n_classes
    return scored.groupBy(*keys).agg(F.round(mean, 12).alias(out))


def scores(cells: DataFrame, n_classes: int | None, keys: Sequence[str] = ()) -> DataFrame:
    """Accuracy, macro and weighted F1, missing predictions and rows, one row per run."""
    rows = _class_rows(cells, keys).withColumn("f1", f1("tp", "predicted", "true"))
    real = F.when(F.col("label") > MISSING, F.col("f1"))
    if n_classes is None:
        macro = F.avg(real)
    else:
        macro = F.sum(F.when(F.col("label") < n_classes, real)) / n_classes
    missing = F.sum(F.when(F.col("label") == MISSING, F.col("predicted")).otherwise(F.lit(0)))
    return rows.groupBy(*keys).agg(
        F.round(F.sum("tp") / F.sum("true"), 6).alias("accuracy"),
        F.round(macro, 6).alias("macro_f1"),
        F.round(F.sum(real * F.col("true")) / F.sum("true"), 6).alias("weighted_f1"),
        F.sum("true").alias("n_rows"),
        missing.alias("n_missing"),
    )


def join_runs(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Join two one-row-per-run tables; without keys each is a single row."""
    if keys:
        return a.join(b, list(keys))
    return a.withColumn(ONE, F.lit(1)).join(b.withColumn(ONE, F.lit(1)), ONE).drop(ONE)


def seed_summary(
    runs: DataFrame, by: Sequence[str], value: str = "macro_f1", ddof: int = 1
) -> DataFrame:
    """Mean, sd and 95% interval of the mean over seeds. The interval always uses the sample sd."""
    spread = F.stddev_samp(value) if ddof == 1 else F.stddev_pop(value)
    half = 1.96 * F.stddev_samp(value) / F.sqrt(F.count(value))
    return runs.groupBy(*by).agg(
        F.count(value).alias("n_seeds"),
        F.round(F.avg(value), 6).alias("mean"),
        F.round(spread, 6).alias("sd"),
        F.round(F.avg(value) - half, 6).alias("ci_lower"),
        F.round(F.avg(value) + half, 6).alias("ci_upper"),
    )


def curve(single: DataFrame, ensemble: DataFrame, validation: int = 500) -> DataFrame:
    """One row per budget: labels really used, single-seed mean and sd, ensemble score."""
    means = seed_summary(single, ["training_size"], ddof=0)
    return means.join(ensemble, "training_size").select(
        "training_size",
        label_budget("training_size", validation).alias("label_budget"),
        F.col("mean").alias("single_seed_mean"),
        F.col("sd").alias("single_seed_sd"),
        F.col("macro_f1").alias("ensemble"),
    )


def confusion_pairs(cells: DataFrame, n_classes: int, top: int = 20) -> DataFrame:
    """The most frequent mistakes among predictions that name a class."""
    wrong = (F.col("y") != F.col("pred")) & F.col("pred").between(0, n_classes - 1)
    return cells.filter(wrong).orderBy(F.desc("n"), "y", "pred").limit(top)


def wrong_sample(df: DataFrame, y: str, pred: str, key: str, n_classes: int, n: int = 15) -> DataFrame:
    """The first wrong predictions that name a class, in key order."""
    wrong = ~is_correct(y, pred) & F.col(pred).between(0, n_classes - 1)
    return df.filter(wrong).orderBy(key).limit(n)


def failure_overlap(df: DataFrame, y: str, a: str, b: str) -> DataFrame:
    """Rows both systems get right, one only, neither, with percentages, and what independent
    failures would give."""
    ok_a, ok_b = is_correct(y, a), is_correct(y, b)
    counts = df.agg(
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(ok_a & ok_b).alias("both_right"),
        F.count_if(ok_a & ~ok_b).alias("a_only"),
        F.count_if(~ok_a & ok_b).alias("b_only"),
        F.count_if(~ok_a & ~ok_b).alias("both_wrong"),
    )
    n = F.col("n_rows")
    percents = [
        F.round(100 * F.col(c) / n, 6).alias(f"{c}_pct")
        for c in ("both_right", "a_only", "b_only", "both_wrong")
    ]
    expected = (F.col("b_only") + F.col("both_wrong")) * (F.col("a_only") + F.col("both_wrong")) / n
    return counts.select("*", *percents, F.round(expected, 6).alias("expected_both_wrong"))


def overlap_verdict(overlap: DataFrame) -> DataFrame:
    """Whether the two systems fail together more or less often than chance."""
    seen, expected = F.col("both_wrong"), F.col("expected_both_wrong")
    return overlap.select(
        "both_wrong",
        "expected_both_wrong",
        F.when(seen > 1.3 * expected, "correlated")
        .when(seen < 0.7 * expected, "anti_correlated")
        .otherwise("independent")
        .alias("verdict"),
    )


def paired_cells(df: DataFrame, y: str, a: str, b: str, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, system, y, pred, n` for systems `a` and `b`, from one pass over the rows."""
    pairs = F.array(*[
        F.struct(F.lit(s).alias("system"), F.col(c).cast("bigint").alias("_pred")) for s, c in (("a", a), ("b", b))])
    return confusion(df.select(*keys, F.col(y).alias("y"), F.inline(pairs)), "y", "_pred", [*keys, "system"])


def class_gaps(cells: DataFrame, n_classes: int, keys: Sequence[str] = ()) -> DataFrame:
    """`keys, label, f1_a, f1_b` from paired cells."""
    side = lambda s: F.max(F.when(F.col("system") == s, F.col("f1"))).alias(f"f1_{s}")
    return per_class(cells, n_classes, [*keys, "system"]).groupBy(*keys, "label").agg(side("a"), side("b"))


def jackknife(gaps: DataFrame, n_classes: int) -> DataFrame:
    """The macro-F1 gap with each class left out, from the per-class scores alone (K rows)."""
    gap = F.col("f1_a") - F.col("f1_b")
    without = (F.sum(gap).over(Window.partitionBy()) - gap) / (n_classes - 1)
    return gaps.select("label", F.round(without, 6).alias("gap_without"))


def jackknife_summary(leave_out: DataFrame, gaps: DataFrame, top: int = 5) -> DataFrame:
    """Full gap, range of the leave-one-out gaps, and the classes whose removal shrinks it most."""
    full = gaps.agg(F.round(F.avg(F.col("f1_a") - F.col("f1_b")), 6).alias("full_gap"))
    ordered = F.array_sort(F.collect_list(F.struct("gap_without", "label")))  # K elements
    spread = leave_out.agg(
        F.min("gap_without").alias("min_gap"),
        F.max("gap_without").alias("max_gap"),
        F.array_join(
            F.transform(F.slice(ordered, 1, top), lambda s: s["label"].cast("string")), ","
        ).alias("top_shrinkers"),
    )
    return join_runs(full, spread, ())


def kept_classes(scored: DataFrame, excluded: Sequence[int], keys: Sequence[str] = (), value: str = "f1") -> DataFrame:
    """Mean F1 over the classes not excluded; every row stays."""
    return scored.filter(~F.col("label").isin(list(excluded))).groupBy(*keys).agg(
        F.round(F.avg(value), 6).alias("macro_f1")
    )


def sensitivity(
    cells: DataFrame, n_classes: int, excluded: Sequence[int], keys: Sequence[str] = ()
) -> DataFrame:
    """The gap over all classes; (A) with classes left out of the mean; (B) with their rows
    dropped as well; and the share of the gap those classes make up. From paired cells."""
    excluded = sorted(set(excluded))
    rows = _class_rows(cells, [*keys, "system"], ~F.col("y").isin(excluded)).filter(F.col("label") > MISSING)
    kept = ~F.col("label").isin(excluded)
    n_kept = n_classes - len(excluded)
    all_f1, kept_f1 = f1("tp", "predicted", "true"), f1("tp", "predicted_kept", "true")

    def mean(system: str, score: Column, which: Column, n: int) -> Column:
        return F.coalesce(F.sum(F.when((F.col("system") == system) & which, score)), F.lit(0.0)) / n

    sides = {
        f"{s}_{name}": mean(s, score, which, n)
        for s in "ab"
        for name, score, which, n in (
            ("all", all_f1, F.lit(True), n_classes), ("A", all_f1, kept, n_kept), ("B", kept_f1, kept, n_kept))
    }
    wide = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in sides.items()])
    gap_all, gap_a = F.col("a_all") - F.col("b_all"), F.col("a_A") - F.col("b_A")
    r = lambda c, name: F.round(c, 6).alias(name)
    return wide.select(
        *keys, r(gap_all, "gap_all"),
        r(F.col("a_A"), "a_kept"), r(gap_a, "gap_kept"),
        r(F.col("a_B"), "a_kept_rows"), r(F.col("a_B") - F.col("b_B"), "gap_kept_rows"),
        r(F.when(gap_all != 0, 1 - gap_a / gap_all), "share_of_gap"),
    )


def seeds_beating(runs: DataFrame, ensemble: DataFrame, baseline: DataFrame) -> DataFrame:
    """Per budget: seeds above the baseline, and whether only the ensemble is.

    `runs`: training_size, seed, macro_f1. `ensemble`: training_size, macro_f1. `baseline`:
    one row, macro_f1.
    """
    base = baseline.select(F.col("macro_f1").alias("baseline"), F.lit(1).alias(ONE))
    per_n = runs.withColumn(ONE, F.lit(1)).join(F.broadcast(base), ONE).groupBy("training_size").agg(
        F.count_if(F.col("macro_f1") > F.col("baseline")).alias("seeds_beating"),
        F.first("baseline").alias("baseline"),
    )
    ens = ensemble.select("training_size", F.col("macro_f1").alias("ensemble"))
    return per_n.join(ens, "training_size").select(
        "training_size", "baseline", "ensemble", "seeds_beating",
        ((F.col("seeds_beating") == 0) & (F.col("ensemble") > F.col("baseline")))
        .alias("ensemble_only"),
    )


def point_crossover(ensemble: DataFrame, baseline: DataFrame) -> DataFrame:
    """The smallest budget whose ensemble reaches the baseline; null if none does."""
    base = baseline.select(F.col("macro_f1").alias("baseline"), F.lit(1).alias(ONE))
    both = ensemble.withColumn(ONE, F.lit(1)).join(F.broadcast(base), ONE)
    return both.agg(
        F.min(F.when(F.col("macro_f1") >= F.col("baseline"), F.col("training_size")))
        .alias("crossover_n")
    )


def budget_gaps(curve_a: DataFrame, curve_b: DataFrame, keys: Sequence[str] = ("training_size",)) -> DataFrame:
    """Score difference of two curves at each budget both were measured at."""
    a = curve_a.select(*keys, F.col("macro_f1").alias("f1_a"))
    b = curve_b.select(*keys, F.col("macro_f1").alias("f1_b"))
    return a.join(b, list(keys)).withColumn("gap", F.round(F.col("f1_a") - F.col("f1_b"), 6))


def run_variance(df: DataFrame, row: str, run: str, pred: str, order: str) -> DataFrame:
    """Agreement of repeated runs over the rows every run predicted; rows left out are counted.

    A run's first non-null prediction of a row by `order` is used, of several at one place the
    smallest. Two aggregates on the row key, each combining map-side.
    """
    first = F.min(F.when(F.col(pred).isNotNull(), F.struct(F.col(order).alias("at"), F.col(pred).alias("p"))))
    per_run = df.groupBy(row, run).agg(first["p"].alias("_p"))
    runs = df.agg(F.countDistinct(run).alias("n_runs")).withColumn(ONE, F.lit(1))
    per_row = per_run.groupBy(row).agg(
        F.count("_p").alias("answered"), (F.min("_p") == F.max("_p")).alias("agree")
    )
    counted = per_row.withColumn(ONE, F.lit(1)).join(F.broadcast(runs), ONE).groupBy("n_runs").agg(
        F.count_if(F.col("answered") == F.col("n_runs")).alias("n_complete"),
        F.count_if(F.col("answered") < F.col("n_runs")).alias("n_dropped"),
        F.count_if((F.col("answered") == F.col("n_runs")) & F.col("agree")).alias("n_unanimous"),
    )
    share = F.when(
        (F.col("n_runs") >= 2) & (F.col("n_complete") > 0), F.col("n_unanimous") / F.col("n_complete")
    )
    return counted.select(
        "n_runs", "n_complete", "n_dropped",
        F.round(share, 6).alias("unanimous"), F.round(1 - share, 6).alias("disagreement"),
    )


def curve_summary(curve_table: DataFrame, baseline: DataFrame | None = None) -> DataFrame:
    """Peak and last point of a curve, and the curve as one JSON record (one entry per budget)."""
    points = F.array_sort(F.collect_list(F.struct("training_size", "ensemble")))
    by_n = F.transform(
        points, lambda p: F.concat_ws(":", p["training_size"].cast("string"),
                                      F.format_string("%.4f", F.round(p["ensemble"], 4))))
    return curve_table.agg(
        F.round(F.max("ensemble"), 4).alias("peak_macro_f1"),
        F.max_by("training_size", F.struct("ensemble", -F.col("training_size"))).alias("peak_n"),
        F.array_join(by_n, ",").alias("ensemble_by_n"),
    )
