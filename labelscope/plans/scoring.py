"""Scores, error analysis and ensembles over predictions derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions.scoring import argmax, is_correct, label_budget, or_missing
from labelscope.operators import ensemble as en
from labelscope.operators import metrics as m
from labelscope.plans.inputs import (
    BUDGETS, DOCS_SQL, ENSEMBLE_SQL, EVENT_TYPES, K, P_SQL, RUNS_SQL, SEEDS, SINGLE_SQL, VOTES_SQL,
    documents, f1_sql, predictions, repeated_runs, table, votes,
)
from labelscope.plans.registry import query
from labelscope.sources import datasets as ds

EXCLUDED = (1, 3)


def _vocabulary(spark):
    return ds.vocabulary_table(spark, EVENT_TYPES)


def _shown(df, *columns):
    """Scores to the six digits that the queries report; operators compare them unrounded."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _cells(spark, d, pred):
    return m.confusion(predictions(spark, d), "y", pred)


def _single_runs(spark, d):
    one = votes(spark, d).select("training_size", "seed", "y", argmax("probs").alias("pred"))
    return m.macro_f1(m.confusion(one, "y", "pred", ["training_size", "seed"]), K, ["training_size", "seed"])


def _ensemble_f1(spark, d):
    voted = en.soft_vote(votes(spark, d), K)
    return m.macro_f1(m.confusion(voted, "y", "pred", ["training_size"]), K, ["training_size"])


VOC_SQL = "voc(label, intent) AS (VALUES (0, 'click'), (1, 'error'), (2, 'purchase'), (3, 'signup'), (4, 'view'))"


@query("p1_label_names", f"""WITH {VOC_SQL}, ids AS (
  SELECT event_id, label FROM events JOIN voc ON event_type = intent)
SELECT event_id, CAST(label AS BIGINT) AS label, intent FROM ids JOIN voc USING (label)""")
def label_names(spark, d):
    voc = _vocabulary(spark)
    ids = ds.names_to_ids(table(spark, d, "events").select("event_id", "event_type"), voc, "event_type", "label")
    return ds.ids_to_names(ids, voc, "label", "intent").select("event_id", "label", "intent")


@query("p2_hallucinated_names", """SELECT event_type || '' AS named, count(*) AS n,
  sum(CASE WHEN event_type IN ('click','error','purchase') THEN 0 ELSE 1 END)::BIGINT AS hallucinated
FROM events GROUP BY 1""")
def hallucinated_names(spark, d):
    # Only three of the five names count as known, so the other two are hallucinations.
    known = _vocabulary(spark).filter("label < 3")
    named = ds.names_to_ids(table(spark, d, "events").select(F.col("event_type").alias("named")), known, "named", "id")
    return named.groupBy("named").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("id").isNull()).alias("hallucinated")
    )


@query("p3_correctness", f"""WITH {P_SQL} SELECT row_id, coalesce(a = y, false) AS a_ok,
  coalesce(b = y, false) AS b_ok FROM p""")
def correctness(spark, d):
    return predictions(spark, d).select("row_id", is_correct("y", "a").alias("a_ok"), is_correct("y", "b").alias("b_ok"))


@query("p4_missing_as_wrong", f"""WITH {P_SQL} SELECT coalesce(b, -1) AS pred, count(*) AS n,
  sum(CASE WHEN coalesce(b, -1) = y THEN 1 ELSE 0 END)::BIGINT AS n_correct FROM p GROUP BY 1""")
def missing_as_wrong(spark, d):
    p = predictions(spark, d).select("y", or_missing("b").alias("pred"))
    return p.groupBy("pred").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("pred") == F.col("y")).alias("n_correct")
    )


@query("p5_remap_vocabulary", """WITH v AS (SELECT source AS intent, row_number() OVER (ORDER BY source) - 1 AS label
  FROM (SELECT DISTINCT source FROM documents))
SELECT label AS old_label, dense_rank() OVER (ORDER BY label) - 1 AS label, intent
FROM v WHERE intent <> 'src10'""")
def remap_vocabulary(spark, d):
    return ds.remap_without(ds.vocabulary_of(table(spark, d, "documents"), "source"), "src10")


@query("p6_out_of_scope", f"""WITH {DOCS_SQL}
SELECT doc_id, lang = 'es' AS held_out,
  CASE lang WHEN 'de' THEN 0 WHEN 'en' THEN 1 WHEN 'fr' THEN 2 END AS label FROM docs""")
def out_of_scope(spark, d):
    rows = documents(spark, d).select("doc_id", "label")
    voc = ds.vocabulary_of(table(spark, d, "documents"), "lang")
    kept, held, _ = ds.hold_out_class(rows, voc, ["es", "oos"])
    return kept.select("doc_id", F.lit(False).alias("held_out"), "label").unionByName(
        held.select("doc_id", F.lit(True).alias("held_out"), F.lit(None).cast("bigint").alias("label"))
    )


@query("p7_exclude_classes", f"""WITH {P_SQL}, kept AS (SELECT * FROM p WHERE y NOT IN (1, 3)),
{f1_sql('a', 'p', pred='a')}, {f1_sql('s', 'kept', pred='a')}
SELECT (SELECT round(avg(f1), 6) FROM f1_a WHERE label NOT IN (1, 3)) AS kept_classes,
       (SELECT round(avg(f1), 6) FROM f1_s WHERE label NOT IN (1, 3)) AS kept_rows""")
def exclude_classes(spark, d):
    cells = _cells(spark, d, "a")
    a = m.kept_classes(m.per_class(cells, K), EXCLUDED).withColumnRenamed("macro_f1", "kept_classes")
    rows = cells.filter(~F.col("y").isin(list(EXCLUDED)))
    b = m.kept_classes(m.per_class(rows, K), EXCLUDED).withColumnRenamed("macro_f1", "kept_rows")
    return m.join_runs(a, b, ())


@query("p8_label_budget", f"""WITH {P_SQL}, {VOTES_SQL}
SELECT training_size, training_size + 500 AS label_budget, training_size + 500 + 15 AS with_demos,
       count(DISTINCT row_id) AS n_rows FROM votes GROUP BY training_size""")
def budget_with_validation(spark, d):
    # A row has one vote per budget and seed, so counting one seed's rows counts the rows.
    v = votes(spark, d).filter(F.col("seed") == SEEDS[0])
    return v.groupBy("training_size").agg(F.count(F.lit(1)).alias("n_rows")).select(
        "training_size", label_budget("training_size").alias("label_budget"),
        label_budget("training_size", demos=3 * K).alias("with_demos"), "n_rows",
    )


@query("e1_macro_f1", f"""WITH {P_SQL}, {f1_sql('a', 'p', pred='a')}, {f1_sql('b', 'p', pred='b')}
SELECT 'a' AS system, round(avg(f1), 6) AS macro_f1 FROM f1_a
UNION ALL SELECT 'b', round(avg(f1), 6) FROM f1_b""")
def macro_f1(spark, d):
    pairs = F.array(*[F.struct(F.lit(s).alias("system"), F.col(s).alias("pred")) for s in "ab"])
    long = predictions(spark, d).select("y", F.inline(pairs))
    return _shown(m.macro_f1(m.confusion(long, "y", "pred", ["system"]), K, ["system"]), "macro_f1")


@query("e1_per_class_f1", f"""WITH {P_SQL}, {f1_sql('b', 'p', pred='b')}
SELECT label, tp::BIGINT AS tp, predicted, n_true AS "true", round(f1, 6) AS f1 FROM f1_b""")
def per_class_f1(spark, d):
    return m.per_class(_cells(spark, d, "b"), K).withColumn("f1", F.round("f1", 6))


SCORES_SQL = """SELECT {g}round(sum(tp) / sum(n_true), 6) AS accuracy, round(avg(f1), 6) AS macro_f1,
  round(sum(f1 * n_true) / sum(n_true), 6) AS weighted_f1, sum(n_true)::BIGINT AS n_rows,
  sum(n_true)::BIGINT - sum(predicted)::BIGINT AS n_missing FROM {f1} {by}"""


@query("e2_scores", f"WITH {P_SQL}, {f1_sql('b', 'p', pred='b')} " + SCORES_SQL.format(g="", f1="f1_b", by=""))
def all_scores(spark, d):
    return m.scores(_cells(spark, d, "b"), K)


@query("e3_observed_macro_f1", f"""WITH {P_SQL}, seen AS (SELECT row_id, y, CASE WHEN b = 4 THEN NULL ELSE b END AS pred
  FROM p WHERE y <> 4), {f1_sql('s', 'seen')}
SELECT round(avg(f1) FILTER (WHERE n_true + predicted > 0), 6) AS observed,
       round(avg(f1), 6) AS fixed FROM f1_s""")
def observed_macro_f1(spark, d):
    p = predictions(spark, d).filter("y <> 4").select("y", F.when(F.col("b") != 4, F.col("b")).alias("pred"))
    cells = m.confusion(p, "y", "pred")
    both = m.join_runs(m.macro_f1(cells, None, out="observed"), m.macro_f1(cells, K, out="fixed"), ())
    return _shown(both, "observed", "fixed")


@query("e4_scores_per_run", f"WITH {P_SQL}, {RUNS_SQL}, {f1_sql('r', 'runs', group='run_index')} "
       + SCORES_SQL.format(g="run_index, ", f1="f1_r", by="GROUP BY run_index"))
def scores_per_run(spark, d):
    return m.scores(m.confusion(repeated_runs(spark, d), "y", "pred", ["run_index"]), K, ["run_index"])


CURVE_CTES = f"""{P_SQL}, {VOTES_SQL}, {SINGLE_SQL}, {ENSEMBLE_SQL},
{f1_sql('single', 'single', group='training_size, seed')},
per_seed AS (SELECT training_size, seed, round(avg(f1), 12) AS macro_f1 FROM f1_single GROUP BY ALL),
{f1_sql('ens', 'ensemble', group='training_size')},
ens AS (SELECT training_size, round(avg(f1), 12) AS macro_f1 FROM f1_ens GROUP BY ALL),
{f1_sql('base', 'p', pred='b')}, base AS (SELECT round(avg(f1), 12) AS macro_f1 FROM f1_base)"""


@query("e5_scores_per_cell", f"WITH {CURVE_CTES} SELECT training_size, seed, round(macro_f1, 6) AS macro_f1 FROM per_seed")
def scores_per_cell(spark, d):
    return _shown(_single_runs(spark, d), "macro_f1")


@query("e6_seed_summary", f"""WITH {CURVE_CTES} SELECT training_size, count(*) AS n_seeds, round(avg(macro_f1), 6) AS mean,
  round(stddev_samp(macro_f1), 6) AS sd,
  round(avg(macro_f1) - 1.96 * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS ci_lower,
  round(avg(macro_f1) + 1.96 * stddev_samp(macro_f1) / sqrt(count(*)), 6) AS ci_upper
FROM per_seed GROUP BY training_size""")
def seed_summary(spark, d):
    return m.seed_summary(_single_runs(spark, d), ["training_size"], ddof=1)


@query("e6_budget_curve", f"""WITH {CURVE_CTES} SELECT training_size, training_size + 500 AS label_budget,
  round(avg(s.macro_f1), 6) AS single_seed_mean, round(stddev_pop(s.macro_f1), 6) AS single_seed_sd,
  round(max(e.macro_f1), 6) AS ensemble FROM per_seed s JOIN ens e USING (training_size) GROUP BY training_size""")
def budget_curve(spark, d):
    return _shown(m.curve(_single_runs(spark, d), _ensemble_f1(spark, d)), "ensemble")


@query("e7_confusion_pairs", f"""WITH {P_SQL} SELECT y, b AS pred, count(*) AS n FROM p
WHERE b IS NOT NULL AND b <> y GROUP BY 1, 2 ORDER BY n DESC, y, pred LIMIT 20""")
def confusion_pairs(spark, d):
    return m.confusion_pairs(_cells(spark, d, "b"), K)


@query("e8_wrong_sample", f"""WITH {P_SQL} SELECT row_id, y, b FROM p WHERE b IS NOT NULL AND b <> y
ORDER BY row_id LIMIT 15""")
def wrong_sample(spark, d):
    return m.wrong_sample(predictions(spark, d).select("row_id", "y", "b"), "y", "b", "row_id", K)


OVERLAP_SQL = f"""{P_SQL}, ok AS (SELECT coalesce(a = y, false) AS a, coalesce(b = y, false) AS b FROM p),
o AS (SELECT count(*) AS n_rows, count(*) FILTER (WHERE a AND b) AS both_right,
  count(*) FILTER (WHERE a AND NOT b) AS a_only, count(*) FILTER (WHERE b AND NOT a) AS b_only,
  count(*) FILTER (WHERE NOT a AND NOT b) AS both_wrong FROM ok),
oo AS (SELECT *, round(100 * both_right / n_rows, 6) AS both_right_pct, round(100 * a_only / n_rows, 6) AS a_only_pct,
  round(100 * b_only / n_rows, 6) AS b_only_pct, round(100 * both_wrong / n_rows, 6) AS both_wrong_pct,
  round((b_only + both_wrong) * (a_only + both_wrong) / n_rows, 6) AS expected_both_wrong FROM o)"""


@query("e9_failure_overlap", f"WITH {OVERLAP_SQL} SELECT * FROM oo")
def failure_overlap(spark, d):
    return m.failure_overlap(predictions(spark, d), "y", "a", "b")


@query("e10_overlap_verdict", f"""WITH {OVERLAP_SQL} SELECT both_wrong, expected_both_wrong,
  CASE WHEN both_wrong > 1.3 * expected_both_wrong THEN 'correlated'
       WHEN both_wrong < 0.7 * expected_both_wrong THEN 'anti_correlated' ELSE 'independent' END AS verdict FROM oo""")
def overlap_verdict(spark, d):
    return m.overlap_verdict(m.failure_overlap(predictions(spark, d), "y", "a", "b"))


GAPS_SQL = f"""{P_SQL}, {f1_sql('a', 'p', pred='a')}, {f1_sql('b', 'p', pred='b')},
gaps AS (SELECT label, x.f1 AS fa, z.f1 AS fb FROM f1_a x JOIN f1_b z USING (label)),
jack AS (SELECT g.label, round((SELECT sum(fa - fb) FROM gaps h WHERE h.label <> g.label) / 4, 6) AS gap_without FROM gaps g)"""


def _gaps(spark, d):
    return m.class_gaps(m.paired_cells(predictions(spark, d), "y", "a", "b"), K)


@query("e11_jackknife", f"WITH {GAPS_SQL} SELECT label, gap_without FROM jack")
def jackknife(spark, d):
    return m.jackknife(_gaps(spark, d), K)


@query("e11_jackknife_summary", f"""WITH {GAPS_SQL} SELECT (SELECT round(avg(fa - fb), 6) FROM gaps) AS full_gap,
  min(gap_without) AS min_gap, max(gap_without) AS max_gap,
  string_agg(CAST(label AS VARCHAR), ',' ORDER BY gap_without, label) AS top_shrinkers FROM jack""")
def jackknife_summary(spark, d):
    gaps = _gaps(spark, d)
    return m.jackknife_summary(m.jackknife(gaps, K), gaps)


@query("e12_gap_sensitivity", f"""WITH {P_SQL}, {VOTES_SQL}, {ENSEMBLE_SQL},
kept AS (SELECT * FROM ensemble WHERE y NOT IN (1, 3)),
{f1_sql('ea', 'ensemble', group='training_size')}, {f1_sql('eb', 'ensemble', pred='b', group='training_size')},
{f1_sql('sa', 'kept', group='training_size')}, {f1_sql('sb', 'kept', pred='b', group='training_size')},
w AS (SELECT training_size, avg(x.f1 - z.f1) AS gap_all, avg(x.f1) FILTER (WHERE label NOT IN (1, 3)) AS aa,
        avg(z.f1) FILTER (WHERE label NOT IN (1, 3)) AS ba
      FROM f1_ea x JOIN f1_eb z USING (training_size, label) GROUP BY 1),
v AS (SELECT training_size, avg(x.f1) AS ab, avg(z.f1) AS bb FROM f1_sa x JOIN f1_sb z USING (training_size, label)
      WHERE label NOT IN (1, 3) GROUP BY 1)
SELECT training_size, round(gap_all, 6) AS gap_all, round(aa, 6) AS a_kept, round(aa - ba, 6) AS gap_kept,
  round(ab, 6) AS a_kept_rows, round(ab - bb, 6) AS gap_kept_rows,
  CASE WHEN gap_all <> 0 THEN round(1 - (aa - ba) / gap_all, 6) END AS share_of_gap
FROM w JOIN v USING (training_size)""")
def gap_sensitivity(spark, d):
    voted = en.soft_vote(votes(spark, d), K, carry=("y", "b"))
    return m.sensitivity(m.paired_cells(voted, "y", "pred", "b", ["training_size"]), K, EXCLUDED, ["training_size"])


@query("e13_seeds_beating", f"""WITH {CURVE_CTES} SELECT s.training_size, round(max(base.macro_f1), 6) AS baseline, round(max(e.macro_f1), 6) AS ensemble,
  count(*) FILTER (WHERE s.macro_f1 > base.macro_f1) AS seeds_beating,
  count(*) FILTER (WHERE s.macro_f1 > base.macro_f1) = 0 AND max(e.macro_f1) > max(base.macro_f1) AS ensemble_only
FROM per_seed s JOIN ens e USING (training_size), base GROUP BY s.training_size""")
def seeds_beating(spark, d):
    base = m.macro_f1(_cells(spark, d, "b"), K)
    return _shown(m.seeds_beating(_single_runs(spark, d), _ensemble_f1(spark, d), base), "baseline", "ensemble")


@query("e14_point_crossover", f"""WITH {CURVE_CTES}
SELECT min(training_size) FILTER (WHERE e.macro_f1 >= base.macro_f1) AS crossover_n FROM ens e, base""")
def point_crossover(spark, d):
    return m.point_crossover(_ensemble_f1(spark, d), m.macro_f1(_cells(spark, d, "b"), K))


@query("e15_budget_gaps", f"""WITH {CURVE_CTES}
SELECT training_size, round(e.macro_f1, 6) AS f1_a, round(s.macro_f1, 6) AS f1_b, round(e.macro_f1 - s.macro_f1, 6) AS gap
FROM ens e JOIN per_seed s USING (training_size) WHERE s.seed = 0""")
def budget_gaps(spark, d):
    first = _single_runs(spark, d).filter(F.col("seed") == 0)
    return _shown(m.budget_gaps(_ensemble_f1(spark, d), first), "f1_a", "f1_b")


@query("e16_run_variance", f"""WITH {P_SQL}, {RUNS_SQL}, w AS (SELECT row_id, count(pred) AS answered,
  count(DISTINCT pred) AS kinds FROM runs GROUP BY row_id)
SELECT CAST(3 AS BIGINT) AS n_runs, count(*) FILTER (WHERE answered = 3) AS n_complete,
  count(*) FILTER (WHERE answered < 3) AS n_dropped,
  round(count(*) FILTER (WHERE answered = 3 AND kinds = 1) / count(*) FILTER (WHERE answered = 3), 6) AS unanimous,
  round(1 - count(*) FILTER (WHERE answered = 3 AND kinds = 1) / count(*) FILTER (WHERE answered = 3), 6) AS disagreement
FROM w""")
def run_variance(spark, d):
    # Every call is answered again later, by another class: only the first answer counts.
    first = repeated_runs(spark, d).withColumn("arrival", F.lit(1))
    again = first.withColumns({"arrival": F.lit(2), "pred": (F.col("pred") + K - 1) % K})
    return m.run_variance(first.unionByName(again), "row_id", "run_index", "pred", "arrival")


@query("e17_curve_summary", f"""WITH {CURVE_CTES} SELECT round(max(macro_f1), 4) AS peak_macro_f1,
  arg_max(training_size, macro_f1) AS peak_n,
  string_agg(CAST(training_size AS VARCHAR) || ':' || printf('%.4f', round(macro_f1, 4)), ',' ORDER BY training_size) AS ensemble_by_n
FROM ens""")
def curve_summary(spark, d):
    return m.curve_summary(_ensemble_f1(spark, d).withColumnRenamed("macro_f1", "ensemble"))


@query("m5_argmax", f"WITH {P_SQL}, {VOTES_SQL}, {SINGLE_SQL} SELECT row_id, training_size, seed, pred FROM single")
def first_argmax(spark, d):
    return votes(spark, d).select("row_id", "training_size", "seed", argmax("probs").alias("pred"))


@query("n1_soft_vote", f"WITH {P_SQL}, {VOTES_SQL}, {ENSEMBLE_SQL} SELECT row_id, training_size, y, CAST(5 AS INTEGER) AS n_seeds, pred FROM ensemble")
def soft_vote(spark, d):
    return en.soft_vote(votes(spark, d), K)


@query("n2_ensemble_scores", f"WITH {P_SQL}, {VOTES_SQL}, {ENSEMBLE_SQL}, {f1_sql('e', 'ensemble', group='training_size')} "
       + SCORES_SQL.format(g="training_size, CAST(5 AS INTEGER) AS n_seeds, ", f1="f1_e", by="GROUP BY training_size"))
def ensemble_scores(spark, d):
    return en.ensemble_scores(en.soft_vote(votes(spark, d), K), K)


_SETS = en.seed_multisets(SEEDS)
_SETS_SQL = "sets(multiset, seed, times) AS (VALUES " + ", ".join(
    f"({i}, {s}, {t})" for i, times, _ in _SETS for s, t in enumerate(times) if t
) + ")"


@query("n3_multiset_votes", f"""WITH {P_SQL}, {VOTES_SQL}, {_SETS_SQL},
mixed AS (SELECT row_id, y, training_size, multiset, k, sum(vote * times) AS v
          FROM votes JOIN sets USING (seed) GROUP BY ALL),
picked AS (SELECT y, training_size, multiset, arg_max(k, v * 10 - k) AS pred FROM mixed
           GROUP BY row_id, y, training_size, multiset)
SELECT training_size, multiset, y, pred, count(*) AS n FROM picked GROUP BY ALL""")
def multiset_votes(spark, d):
    cells = en.multiset_counts(votes(spark, d), _SETS, K, BUDGETS, SEEDS)
    each = F.array(*[
        F.struct(F.lit(b).cast("bigint").alias("training_size"), F.col(f"n{b}").alias("pred")) for b in BUDGETS])
    mixed = cells.select("multiset", "y", "n", F.inline(each))
    return mixed.groupBy("training_size", "multiset", "y", "pred").agg(F.sum("n").alias("n"))
