"""Resampling over predictions and votes derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions.scoring import argmax
from labelscope.operators import ensemble as en
from labelscope.operators import resample as rs
from labelscope.plans.inputs import (
    BUDGETS, ENSEMBLE_SQL, K, P_SQL, SEEDS, SINGLE_SQL, VOTES_SQL, f1_sql, predictions, votes,
)
from labelscope.plans.registry import query

SWAPS, WEIGHTS = 64, 20  # replicates of the hash forms; the SQL side works row by row


@query("i1_paired_bootstrap")
def paired_bootstrap(spark, d):
    return rs.paired_bootstrap(predictions(spark, d), "y", "a", "b", K, replicates=5000)


@query("i2_permutation_test")
def permutation_test(spark, d):
    return rs.paired_permutation(predictions(spark, d), "y", "a", "b", K, replicates=10_000)


def swap_sql(src: str, group: str, a: str, b: str, n: int) -> str:
    """CTEs from `src` to `diffs(group, rep, diff)` and `seen(group, d)` for hash-decided swaps."""
    g = f"{group}, " if group else ""
    keys = f"{g}rep"
    return f"""swaps AS (SELECT {g}y, rep, CASE WHEN sw THEN {b} ELSE {a} END AS pa, CASE WHEN sw THEN {a} ELSE {b} END AS pb
  FROM (SELECT *, substr(md5('42:' || (rep // 32) || ':' || row_id), CAST(rep % 32 + 1 AS BIGINT), 1) < '8' AS sw
        FROM {src}, (SELECT unnest(range({n})) AS rep))),
{f1_sql('pa', 'swaps', pred='pa', group=keys)}, {f1_sql('pb', 'swaps', pred='pb', group=keys)},
diffs AS (SELECT {keys}, sum(x.f1 - z.f1) / 5 AS diff FROM f1_pa x JOIN f1_pb z USING ({keys}, label) GROUP BY ALL),
{f1_sql('oa', src, pred=a, group=group)}, {f1_sql('ob', src, pred=b, group=group)},
seen AS (SELECT {g}sum(x.f1 - z.f1) / 5 AS d FROM f1_oa x JOIN f1_ob z USING ({g}label) {'GROUP BY ' + group if group else ''})"""


@query("i2_permutation_by_hash", f"""WITH {P_SQL}, {swap_sql('p', '', 'a', 'b', SWAPS)}
SELECT round(max(d), 6) AS observed_diff, count(*) AS n_replicates,
  round((count(*) FILTER (WHERE abs(round(diff, 12)) >= abs(round(d, 12))) + 1) / (count(*) + 1), 6) AS p_value FROM diffs, seen""")
def permutation_by_hash(spark, d):
    return rs.permutation_by_hash(predictions(spark, d), "y", "a", "b", "row_id", K, SWAPS, 42)


@query("i3_seeds_and_rows")
def seeds_and_rows(spark, d):
    return rs.hierarchical_bootstrap(votes(spark, d), "b", 250, SEEDS, K, replicates=2000)


@query("i3_rows_only")
def rows_only(spark, d):
    return rs.hierarchical_bootstrap(votes(spark, d), "b", 250, SEEDS, K, replicates=2000, resample_seeds=False)


@query("i3_every_budget")
def every_budget(spark, d):
    return rs.hierarchical_gaps(votes(spark, d), "b", BUDGETS, SEEDS, K, replicates=2000)


@query("i4_crossover_interval")
def crossover_interval(spark, d):
    return rs.crossover_interval(votes(spark, d), "b", BUDGETS, SEEDS, K, replicates=2000)


_T = rs.poisson_thresholds()


def weight_sql(seed: int, rep: str = "rep") -> str:
    u = (f"CAST('0x' || substr(md5('{seed}:' || ({rep} // 4) || ':' || row_id), "
         f"CAST(8 * ({rep} % 4) + 1 AS BIGINT), 8) AS BIGINT)")
    steps = " + ".join(f"(CASE WHEN u >= {t} THEN 1 ELSE 0 END)" for t in _T)
    return u, steps


def weighted_f1_sql(name: str, src: str, pred: str, group: str) -> str:
    """F1 per group and class from rows with a weight w."""
    return f"""t_{name} AS (SELECT {group}, y AS label, sum(w) AS n_true, sum(CASE WHEN y = {pred} THEN w ELSE 0 END) AS tp FROM {src} GROUP BY ALL),
q_{name} AS (SELECT {group}, {pred} AS label, sum(w) AS predicted FROM {src} WHERE {pred} IS NOT NULL GROUP BY ALL),
f_{name} AS (SELECT {group}, sum(CASE WHEN coalesce(predicted, 0) + coalesce(n_true, 0) > 0
    THEN 2.0 * coalesce(tp, 0) / (coalesce(predicted, 0) + coalesce(n_true, 0)) ELSE 0.0 END) / 5 AS f1
  FROM t_{name} FULL JOIN q_{name} USING ({group}, label) GROUP BY {group})"""


_U, _STEPS = weight_sql(42)
BOOT_SQL = f"""{P_SQL}, drawn AS (SELECT y, a, b, rep, {_STEPS} AS w FROM (SELECT *, {_U} AS u
  FROM p, (SELECT unnest(range({WEIGHTS})) AS rep))),
{weighted_f1_sql('a', 'drawn', 'a', 'rep')}, {weighted_f1_sql('b', 'drawn', 'b', 'rep')},
reps AS (SELECT rep, x.f1 AS a, z.f1 AS b FROM f_a x JOIN f_b z USING (rep)),
{f1_sql('oa', 'p', pred='a')}, {f1_sql('ob', 'p', pred='b')},
summary AS (SELECT round((SELECT avg(f1) FROM f1_oa) - (SELECT avg(f1) FROM f1_ob), 6) AS observed_diff, round(avg(a - b), 6) AS bootstrap_mean,
  round(quantile_cont(a - b, 0.025), 6) AS ci_lower, round(quantile_cont(a - b, 0.975), 6) AS ci_upper, count(*) AS n_replicates FROM reps)"""


@query("i5_poisson_replicates", f"WITH {BOOT_SQL} SELECT rep, round(a, 6) AS a, round(b, 6) AS b FROM reps")
def poisson_replicates(spark, d):
    reps = rs.poisson_bootstrap(predictions(spark, d), "y", "a", "b", "row_id", K, WEIGHTS, 42)
    return reps.select("rep", F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


def _summary(spark, d):
    p = predictions(spark, d)
    reps = rs.poisson_bootstrap(p, "y", "a", "b", "row_id", K, WEIGHTS, 42)
    seen = rs.observed_scores(rs.outcome_cells(p, "y", ("a", "b")), ("a", "b"), K)
    return rs.difference_summary(reps, seen.select(F.round(F.col("a") - F.col("b"), 6).alias("observed_diff")))


@query("i5_poisson_bootstrap", f"WITH {BOOT_SQL} SELECT * FROM summary")
def poisson_bootstrap(spark, d):
    return _summary(spark, d)


@query("i6_interval_verdict", f"""WITH {BOOT_SQL} SELECT *, CASE WHEN ci_lower > 0 THEN 'a_better' WHEN ci_upper < 0 THEN 'b_better'
  ELSE 'not_significant' END AS verdict FROM summary""")
def interval_verdict(spark, d):
    return rs.verdict(_summary(spark, d))


@query("i6_bootstrap_verdict")
def bootstrap_verdict(spark, d):
    return rs.verdict(rs.paired_bootstrap(predictions(spark, d), "y", "a", "b", K, replicates=5000))


def _arms(v):
    """Each arm's prediction beside that of its budget's ensemble. Both sides have a row for every
    event, so neither is sent whole through the driver, however well it compresses."""
    ens = en.soft_vote(v, K).select("row_id", "training_size", F.col("pred").alias("b"))
    single = v.select("row_id", "y", F.col("seed").alias("arm"), "training_size", argmax("probs").alias("a"))
    return single.join(ens.hint("merge"), ["row_id", "training_size"])


@query("i7_test_matrix", f"""WITH {P_SQL}, {VOTES_SQL}, {SINGLE_SQL}, {ENSEMBLE_SQL},
arms AS (SELECT row_id, y, seed AS arm, training_size, s.pred AS pa, e.pred AS pb FROM single s
  JOIN ensemble e USING (row_id, y, training_size)),
src AS (SELECT row_id, y, arm, training_size, pa AS a, pb AS b FROM arms),
{swap_sql('src', 'arm, training_size', 'a', 'b', 32)}
SELECT arm, training_size, round(max(d), 6) AS observed_diff, count(*) AS n_replicates,
  round((count(*) FILTER (WHERE abs(round(diff, 12)) >= abs(round(d, 12))) + 1) / (count(*) + 1), 6) AS p_value
FROM diffs JOIN seen USING (arm, training_size) GROUP BY ALL""")
def test_matrix(spark, d):
    both = _arms(votes(spark, d))
    return rs.permutation_by_hash(both, "y", "a", "b", "row_id", K, 32, 42, keys=("arm", "training_size"))


@query("i7_whole_matrix")
def whole_matrix(spark, d):
    """Every arm and budget against the ensemble of its budget."""
    both = _arms(votes(spark, d))
    return rs.paired_permutation(both, "y", "a", "b", K, replicates=10_000, keys=("arm", "training_size"))


_PICKS = ", ".join(
    f"CAST('0x' || substr(md5('42:draw{j}:' || rep), 1, 8) AS BIGINT) % 5 AS d{j}" for j in range(5))
_TIMES = ", ".join(
    f"({s}, " + " + ".join(f"(CASE WHEN d{j} = {s} THEN 1 ELSE 0 END)" for j in range(5)) + ")" for s in range(5))
_UC, _STEPSC = weight_sql(42)
CROSS_SQL = f"""{P_SQL}, {VOTES_SQL}, draws AS (SELECT rep, {_PICKS} FROM (SELECT unnest(range(12)) AS rep)),
times AS (SELECT rep, seed, times FROM draws, LATERAL (VALUES {_TIMES}) v(seed, times) WHERE times > 0),
mixed AS (SELECT row_id, y, b, training_size, rep, k, sum(vote * times) AS v FROM votes JOIN times USING (seed) GROUP BY ALL),
picked AS (SELECT row_id, y, b, training_size, rep, arg_max(k, v * 10 - k) AS pred FROM mixed GROUP BY row_id, y, b, training_size, rep),
drawn AS (SELECT y, b, training_size, rep, pred, {_STEPSC} AS w FROM (SELECT *, {_UC} AS u FROM picked)),
{weighted_f1_sql('e', 'drawn', 'pred', 'rep, training_size')},
{weighted_f1_sql('b', 'drawn', 'b', 'rep, training_size')},
found AS (SELECT rep, min(training_size) FILTER (WHERE x.f1 >= z.f1) AS crossover_n FROM f_e x JOIN f_b z USING (rep, training_size) GROUP BY rep)"""


@query("i4_crossover_replicates", f"WITH {CROSS_SQL} SELECT rep, crossover_n FROM found")
def crossover_replicates(spark, d):
    reps = rs.seed_row_replicates_by_hash(votes(spark, d), "b", BUDGETS, SEEDS, K, 12, 42)
    return rs.crossovers(reps, BUDGETS)


@query("i4_crossover_by_hash", f"""WITH {CROSS_SQL} SELECT floor(quantile_cont(crossover_n, 0.5))::BIGINT AS median_n,
  floor(quantile_cont(crossover_n, 0.025))::BIGINT AS ci_lower_n, floor(quantile_cont(crossover_n, 0.975))::BIGINT AS ci_upper_n,
  round(count(*) FILTER (WHERE crossover_n IS NULL) / count(*), 4) AS never_share, count(*) AS n_replicates,
  '50:' || count(*) FILTER (WHERE crossover_n = 50) || ',100:' || count(*) FILTER (WHERE crossover_n = 100)
  || ',250:' || count(*) FILTER (WHERE crossover_n = 250) || ',500:' || count(*) FILTER (WHERE crossover_n = 500) AS distribution FROM found""")
def crossover_by_hash(spark, d):
    reps = rs.seed_row_replicates_by_hash(votes(spark, d), "b", BUDGETS, SEEDS, K, 12, 42)
    return rs.crossover_summary(rs.crossovers(reps, BUDGETS), BUDGETS)


@query("i3_every_budget_by_hash", f"""WITH {CROSS_SQL}, {ENSEMBLE_SQL}, {f1_sql('ens', 'ensemble', group='training_size')},
{f1_sql('base', 'ensemble', pred='b', group='training_size')},
seen AS (SELECT training_size, sum(x.f1 - z.f1) / 5 AS d FROM f1_ens x JOIN f1_base z USING (training_size, label) GROUP BY 1)
SELECT training_size, round(max(d), 6) AS observed_diff, round(avg(x.f1 - z.f1), 6) AS bootstrap_mean,
  round(quantile_cont(x.f1 - z.f1, 0.025), 6) AS ci_lower, round(quantile_cont(x.f1 - z.f1, 0.975), 6) AS ci_upper, count(*) AS n_replicates
FROM f_e x JOIN f_b z USING (rep, training_size) JOIN seen USING (training_size) GROUP BY training_size""")
def every_budget_by_hash(spark, d):
    v = votes(spark, d)
    reps = rs.seed_row_replicates_by_hash(v, "b", BUDGETS, SEEDS, K, 12, 42)
    return rs.gap_intervals(reps, BUDGETS, rs.observed_curve(v, "b", BUDGETS, SEEDS, K))
