"""Cost and latency over the call log derived from `events`."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelscope.functions import pricing as pr
from labelscope.operators import costs as co
from labelscope.operators import ensemble as en
from labelscope.operators import metrics as m
from labelscope.operators.quantiles import exact_percentiles
from labelscope.plans.inputs import K, P_SQL, predictions, table, votes
from labelscope.plans.registry import query
from labelscope.plans.scoring import CURVE_CTES

UNCACHED, CACHED = pr.standard_price(False), pr.standard_price(True)
MODELS = ("claude-sonnet-4-6", "claude-haiku-4-5", "some-future-model")


def _call_log(spark, d):
    p = predictions(spark, d)
    call = F.col("call_no")
    model = F.get(F.array(*[F.lit(x) for x in MODELS]), (call % 3).cast("int"))
    return p.select(
        "row_id", (F.col("y") % 2).alias("run_index"), call.alias("call_id"), model.alias("model"),
        F.when(call % 19 != 4, F.col("input_tokens")).alias("input_tokens"), "output_tokens",
        ((call * 7) % 900).alias("cache_read_input_tokens"), ((call % 5) * 100).alias("cache_creation_input_tokens"),
        "latency_ms")


_CASES = "CASE call_no % 3 WHEN 0 THEN 'claude-sonnet-4-6' WHEN 1 THEN 'claude-haiku-4-5' ELSE 'some-future-model' END"
COST_SQL = f"""{P_SQL}, calls AS (SELECT {_CASES} AS model, call_no, y % 2 AS run, count(*) AS n,
    max(CASE WHEN call_no % 19 <> 4 THEN input_tokens ELSE 0 END) AS i, max(output_tokens) AS o, (call_no * 7) % 900 AS r, (call_no % 5) * 100 AS w
  FROM p GROUP BY ALL),
t AS (SELECT model, sum(i) AS i, sum(o) AS o, sum(r) AS r, sum(w) AS w, sum(n) AS n,
  CASE model WHEN 'claude-sonnet-4-6' THEN 3.0 WHEN 'claude-haiku-4-5' THEN 1.0 END::DOUBLE AS ir,
  CASE model WHEN 'claude-sonnet-4-6' THEN 15.0 WHEN 'claude-haiku-4-5' THEN 5.0 END::DOUBLE AS orr FROM calls GROUP BY model),
u AS (SELECT *, {{mult}} * (i * ir + o * orr + r * ir * 0.1::DOUBLE + w * ir * 1.25::DOUBLE) / 1e6 AS usd FROM t)
SELECT model, i::BIGINT AS input_tokens, o::BIGINT AS output_tokens, r::BIGINT AS cache_read_input_tokens, w::BIGINT AS cache_creation_input_tokens,
  n::BIGINT AS n_predictions, round(usd, 4) AS total_usd, round(usd / n * 1000, 4) AS usd_per_1k_predictions,
  CASE WHEN ir IS NULL THEN 'no price on file' END AS error FROM u"""


@query("c1_measured_cost", "WITH " + COST_SQL.replace("{mult}", "1.0::DOUBLE"))
def measured_cost(spark, d):
    return co.measured_cost(_call_log(spark, d), pr.price_table(spark), batch=False)


@query("c2_batch_cost_per_1k", "WITH " + COST_SQL.replace("{mult}", "0.5::DOUBLE"))
def batch_cost(spark, d):
    return co.measured_cost(_call_log(spark, d), pr.price_table(spark), batch=True)


@query("c3_call_latency", f"""WITH {P_SQL}, c AS (SELECT call_no, y % 2 AS run, max(latency_ms) AS ms FROM p WHERE latency_ms IS NOT NULL GROUP BY ALL)
SELECT count(*) AS n_calls, round(quantile_cont(ms, 0.5), 1) AS p50_ms, round(quantile_cont(ms, 0.95), 1) AS p95_ms,
  round(quantile_cont(ms, 0.99), 1) AS p99_ms, round(min(ms), 1)::DOUBLE AS min_ms, round(max(ms), 1)::DOUBLE AS max_ms FROM c""")
def call_latency(spark, d):
    return co.latency_summary(_call_log(spark, d), "run_index", "call_id")


@query("c3_latency_by_type", """SELECT event_type, count(*) AS n_calls, round(quantile_cont(value, 0.5), 1) AS p50_ms,
  round(quantile_cont(value, 0.95), 1) AS p95_ms, round(quantile_cont(value, 0.99), 1) AS p99_ms, round(min(value), 1) AS min_ms,
  round(max(value), 1) AS max_ms FROM events WHERE value IS NOT NULL GROUP BY 1""")
def latency_by_type(spark, d):
    log = table(spark, d, "events").select("event_type", F.lit(0).alias("run"), "event_id", "value")
    return co.latency_summary(log, "run", "event_id", "value", ["event_type"])


@query("c4_query_prices", f"""WITH {P_SQL}, w AS (SELECT y, avg(input_tokens + 400) AS ti, avg(output_tokens) AS t_out FROM p GROUP BY 1)
SELECT y, round(ti / 1e6 * 3.0 + t_out / 1e6 * 15.0, 8) AS api_uncached,
  round(100 / 1e6 * 3.0 + (ti - 100) / 1e6 * 0.3 + t_out / 1e6 * 15.0, 8) AS api_cached,
  round(0.5 / 72000.0, 10) AS self_hosted, round(0.5 / 720000.0, 10) AS self_hosted_full,
  round((ti / 1e6 * 3.0 + t_out / 1e6 * 15.0) / (0.5 / 72000.0), 4) AS api_to_self_hosted FROM w""")
def query_prices(spark, d):
    w = predictions(spark, d).groupBy("y").agg(
        F.avg(F.col("input_tokens") + 400).alias("ti"), F.lit(100.0).alias("tq"), F.avg("output_tokens").alias("to"))
    return co.query_prices(w, "ti", "tq", "to").drop("ti", "tq", "to")


@query("c5_serving_cost", """WITH q AS (SELECT event_type, quantile_cont(value, 0.5) AS p50 FROM events GROUP BY 1),
w AS (SELECT event_type, 1000.0 / (p50 / 64) AS qps, CASE WHEN event_type = 'click' THEN 0.05 ELSE 0.5 END::DOUBLE AS h FROM q)
SELECT event_type, round(qps, 1) AS queries_per_second, round(h / 3600 / qps * 1e6, 4) AS usd_per_1m_queries, h AS usd_per_hour,
  round(h * 24 * 30, 2) AS monthly_fixed_usd, floor(h * 24 * 30 / 0.00525::DOUBLE)::BIGINT AS breakeven_queries_per_month FROM w""")
def serving_cost(spark, d):
    q = exact_percentiles(table(spark, d, "events"), "value", {"p50": 0.5}, ["event_type"])
    return co.serving_cost(q, "p50", 64, F.col("event_type") == "click", UNCACHED, ["event_type"])


# Events stand for 30, 60, ... 150 calls by class, so workloads fall on both sides of break-even.
VOLUME_SQL = f"""{P_SQL}, volumes AS (SELECT event_type AS workload, strftime(ts, '%Y-%m') AS month, sum(30 * (y + 1))::BIGINT AS queries,
  count(DISTINCT user_id) * 4 - 100 * max(y) AS n_labels FROM events JOIN p ON row_id = event_id GROUP BY 1, 2)"""


def _log(spark, d):
    from labelscope.plans.inputs import event_class
    return table(spark, d, "events").select("event_type", "ts", "user_id", event_class().alias("y"))


def _workloads(spark, d):
    volumes = co.monthly_volumes(_log(spark, d), "event_type", "ts", 30 * (F.col("y") + 1))
    labels = _log(spark, d).groupBy(F.col("event_type").alias("workload")).agg(
        (F.countDistinct("user_id") * 4 - 100 * F.max("y")).alias("n_labels"))
    return volumes.join(labels, "workload")


@query("c6_monthly_costs", f"""WITH {VOLUME_SQL} SELECT workload, month, queries, round(queries * 0.00525::DOUBLE, 4) AS api_usd,
  round(queries * 0.00147::DOUBLE, 4) AS api_cached_usd, 360.0::DOUBLE AS self_host_usd, 68571 AS breakeven_uncached, 244897 AS breakeven_cached,
  CASE WHEN queries * 0.00525::DOUBLE < 360 THEN 'api' ELSE 'self_host' END AS cheaper_uncached,
  CASE WHEN queries * 0.00147::DOUBLE < 360 THEN 'api' ELSE 'self_host' END AS cheaper_cached FROM volumes""")
def monthly_costs(spark, d):
    return co.monthly_costs(co.monthly_volumes(_log(spark, d), "event_type", "ts", 30 * (F.col("y") + 1)), UNCACHED, CACHED)


def _curve(spark, d):
    voted = en.soft_vote(votes(spark, d), K)
    return m.macro_f1(m.confusion(voted, "y", "pred", ["training_size"]), K, ["training_size"])


@query("c7_decision_table", f"""WITH {CURVE_CTES}, {VOLUME_SQL[len(P_SQL) + 2:]},
near AS (SELECT v.*, e.training_size AS n, e.macro_f1 AS q, row_number() OVER (PARTITION BY workload, month
  ORDER BY abs(e.training_size - n_labels), e.training_size) AS r FROM volumes v, ens e)
SELECT workload, month, n_labels, queries, 'ensemble' AS system, n AS nearest_n, round(q, 3) AS macro_f1, q >= 0.8 AS meets_required,
  round(queries * 0.00525::DOUBLE, 2) AS api_usd, 360.0::DOUBLE AS self_host_usd,
  CASE WHEN queries * 0.00525::DOUBLE > 360 THEN round(n_labels * 0.5 / greatest(queries * 0.00525::DOUBLE - 360, 1.0), 4) END AS payback_months,
  CASE WHEN q < 0.8 THEN 'api_quality' WHEN queries * 0.00525::DOUBLE < 360 THEN 'api_volume' ELSE 'self_host' END AS recommendation
FROM near WHERE r = 1""")
def decision_table(spark, d):
    return co.decision_table(_workloads(spark, d), _curve(spark, d), 0.8, UNCACHED)


@query("c8_calculator", f"""WITH {CURVE_CTES}, {VOLUME_SQL[len(P_SQL) + 2:]},
seg AS (SELECT training_size AS n0, macro_f1 AS q0, lead(training_size) OVER (ORDER BY training_size) AS n1,
  lead(macro_f1) OVER (ORDER BY training_size) AS q1 FROM ens),
x AS (SELECT *, least(greatest(n_labels, (SELECT min(n0) FROM seg)), (SELECT max(n0) FROM seg)) AS c FROM volumes),
j AS (SELECT x.*, q0 + (c - n0) / (n1 - n0) * (q1 - q0) AS q, queries * 0.00525::DOUBLE AS api, 360 + queries * 0.000007::DOUBLE AS own,
  row_number() OVER (PARTITION BY workload, month ORDER BY n0) AS r FROM x JOIN seg ON c >= n0 AND c <= n1),
k AS (SELECT *, CASE WHEN api > own THEN n_labels * 0.5 / (api - own) END AS months,
  CASE WHEN n_labels < 100 THEN 'too_few_labels' WHEN api <= own THEN 'api' ELSE 'self_host' END AS verdict FROM j WHERE r = 1)
SELECT workload, month, n_labels, queries, round(q, 6) AS macro_f1, round(api, 4) AS api_usd, round(own, 4) AS self_host_usd,
  floor(360 / (0.00525::DOUBLE - 0.000007::DOUBLE))::BIGINT AS breakeven_queries, verdict,
  CASE WHEN verdict = 'self_host' THEN CASE WHEN months < 0.1 THEN 'instantly' WHEN months < 1 THEN printf('in %.0f days', months * 30)
    ELSE printf('in %.1f months', months) END END AS payback FROM k""")
def calculator(spark, d):
    return co.calculator(_workloads(spark, d), _curve(spark, d), UNCACHED)
