"""Cost, latency and decision arithmetic over call logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelscope.functions import pricing as pr
from labelscope.operators.quantiles import exact_percentiles

TOKENS = ("input_tokens", "output_tokens", "cache_read_input_tokens", "cache_creation_input_tokens")


def measured_cost(
    df: DataFrame, prices: DataFrame, batch: bool, run: str = "run_index", call: str = "call_id",
    model: str = "model", keys: Sequence[str] = (),
) -> DataFrame:
    """Cost per model from measured tokens.

    Usage repeats on every row of a call, so it is billed once per (run, call). A model with
    no price gets an error instead of a cost. The per-1k figure divides by all prediction
    rows of all runs.
    """
    keys = list(keys)
    per_call = df.groupBy(*keys, model, run, call).agg(
        *[F.max(F.coalesce(F.col(t), F.lit(0))).alias(t) for t in TOKENS], F.count(F.lit(1)).alias("n"))
    sums = per_call.groupBy(*keys, model).agg(
        *[F.sum(t).alias(t) for t in TOKENS], F.sum("n").alias("n_predictions"))
    priced = sums.join(prices.withColumnRenamed("model", model), model, "left")
    per_million = (
        F.col("input_tokens") * F.col("input_rate") + F.col("output_tokens") * F.col("output_rate")
        + F.col("cache_read_input_tokens") * F.col("input_rate") * pr.CACHE_READ
        + F.col("cache_creation_input_tokens") * F.col("input_rate") * pr.CACHE_WRITE
    )
    usd = (pr.BATCH if batch else 1.0) * per_million / 1e6
    return priced.select(
        *keys, model, *TOKENS, "n_predictions",
        F.round(usd, 4).alias("total_usd"),
        F.round(usd / F.col("n_predictions") * 1000, 4).alias("usd_per_1k_predictions"),
        F.when(F.col("input_rate").isNull(), F.lit("no price on file")).alias("error"),
    )


def latency_summary(
    df: DataFrame, run: str, call: str, latency: str = "latency_ms", keys: Sequence[str] = ()
) -> DataFrame:
    """Calls timed, p50, p95, p99, min and max per call; no row where nothing was timed."""
    per_call = df.filter(F.col(latency).isNotNull()).groupBy(*keys, run, call).agg(F.max(latency).alias("ms"))
    q = exact_percentiles(per_call, "ms", {"p50": 0.5, "p95": 0.95, "p99": 0.99}, keys)
    return q.select(
        *keys, F.col("n").alias("n_calls"),
        *[F.round(c, 1).alias(f"{c}_ms") for c in ("p50", "p95", "p99", "min", "max")])


def query_prices(df: DataFrame, tokens_in: str, tokens_query: str, tokens_out: str, utilisation: float = 0.10) -> DataFrame:
    """Adds the price of one query: API with and without caching, self-hosted, and their ratio."""
    args = F.col(tokens_in), F.col(tokens_query), F.col(tokens_out)
    uncached, hosted = pr.api_price(*args, cached=False), pr.self_hosted_price(utilisation)
    return df.select(
        "*",
        F.round(uncached, 8).alias("api_uncached"),
        F.round(pr.api_price(*args, cached=True), 8).alias("api_cached"),
        F.round(hosted, 10).alias("self_hosted"),
        F.round(pr.self_hosted_price(1.0), 10).alias("self_hosted_full"),
        F.round(uncached / hosted, 4).alias("api_to_self_hosted"),
    )


def serving_cost(
    df: DataFrame, batch_ms: str, batch: int, on_cpu: Column, api_price: float, keep: Sequence[str]
) -> DataFrame:
    """From milliseconds per batch to throughput, price at full use, fixed cost and break-even."""
    qps = F.lit(1000.0) / (F.col(batch_ms) / batch)
    hourly = F.when(on_cpu, pr.CPU_HOURLY).otherwise(pr.GPU_HOURLY)
    monthly = hourly * 24 * 30
    return df.select(
        *keep,
        F.round(qps, 1).alias("queries_per_second"),
        F.round(hourly / 3600 / qps * 1e6, 4).alias("usd_per_1m_queries"),
        hourly.alias("usd_per_hour"),
        F.round(monthly, 2).alias("monthly_fixed_usd"),
        F.floor(monthly / api_price).cast("bigint").alias("breakeven_queries_per_month"),
    )


def monthly_volumes(log: DataFrame, workload: str, ts: str, per_row: Column | int = 1) -> DataFrame:
    """`workload, month, queries` from a call log."""
    each = per_row if isinstance(per_row, Column) else F.lit(per_row)
    return log.groupBy(F.col(workload).alias("workload"), F.date_format(ts, "yyyy-MM").alias("month")).agg(
        F.sum(each).cast("bigint").alias("queries"))


def monthly_costs(volumes: DataFrame, uncached: float, cached: float, fixed: float = pr.FIXED_MONTHLY) -> DataFrame:
    """API and self-hosting cost of each workload and month, break-even volumes, cheaper side."""
    q = F.col("queries")
    return volumes.select(
        "workload", "month", "queries",
        F.round(q * uncached, 4).alias("api_usd"),
        F.round(q * cached, 4).alias("api_cached_usd"),
        F.lit(float(fixed)).alias("self_host_usd"),
        F.lit(int(fixed // uncached)).cast("bigint").alias("breakeven_uncached"),
        F.lit(int(fixed // cached)).cast("bigint").alias("breakeven_cached"),
        F.when(q * uncached < fixed, "api").otherwise("self_host").alias("cheaper_uncached"),
        F.when(q * cached < fixed, "api").otherwise("self_host").alias("cheaper_cached"),
    )


def _with_curve(df: DataFrame, curve: DataFrame) -> DataFrame:
    """Every row with the whole quality curve: `_curve`, one element per measured budget."""
    points = curve.agg(
        F.array_sort(F.collect_list(F.struct(
            F.col("training_size").cast("double").alias("n"), F.col("macro_f1").alias("q")))).alias("_curve"),
        F.lit(1).alias("_one"))
    return df.withColumn("_one", F.lit(1)).join(F.broadcast(points), "_one").drop("_one")  # one row


def _row_keys(workloads: DataFrame) -> list[str]:
    return [c for c in ("workload", "month") if c in workloads.columns]


def decision_table(
    workloads: DataFrame, curve: DataFrame, required_f1: float, api_price: float, system: str = "ensemble",
    fixed: float = pr.FIXED_MONTHLY,
) -> DataFrame:
    """Build or buy, per workload and month. `workloads`: workload, n_labels, queries, and month if
    there is more than one.

    Quality is that of the nearest measured budget (the smaller on a tie), and `system` says
    which kind of system it belongs to.
    """
    nearest = F.array_min(F.transform("_curve", lambda p: F.struct(
        F.abs(p["n"] - F.col("n_labels")).alias("d"), p["n"].alias("n"), p["q"].alias("q"))))
    api = F.col("queries") * api_price
    saving = api - fixed
    base = _with_curve(workloads, curve).withColumn("_p", nearest)
    payback = F.when(saving > 0, F.col("n_labels") * pr.COST_PER_LABEL / F.greatest(saving, F.lit(1.0)))
    meets = F.col("_p.q") >= required_f1
    return base.select(
        *_row_keys(workloads), "n_labels", "queries",
        F.lit(system).alias("system"),
        F.col("_p.n").cast("bigint").alias("nearest_n"),
        F.round("_p.q", 3).alias("macro_f1"),
        meets.alias("meets_required"),
        F.round(api, 2).alias("api_usd"),
        F.lit(float(fixed)).alias("self_host_usd"),
        F.round(payback, 4).alias("payback_months"),
        F.when(~meets, "api_quality").when(api < fixed, "api_volume").otherwise("self_host")
        .alias("recommendation"),
    )


def interpolated_quality(x: str) -> Column:
    """Score at x labels on `_curve`: linear between measured points, flat outside them."""
    below = F.array_max(F.filter("_curve", lambda p: p["n"] <= F.col(x)))
    above = F.array_min(F.filter("_curve", lambda p: p["n"] >= F.col(x)))
    lo, hi = F.coalesce(below, above), F.coalesce(above, below)
    t = F.when(hi["n"] > lo["n"], (F.col(x) - lo["n"]) / (hi["n"] - lo["n"])).otherwise(F.lit(0.0))
    return lo["q"] + t * (hi["q"] - lo["q"])


def payback_text(months: Column) -> Column:
    """The payback time in words. The limits and wordings are fixed values."""
    return (
        F.when(months < 0.1, "instantly")
        .when(months < 1, F.format_string("in %.0f days", months * 30))
        .when(months.isNotNull(), F.format_string("in %.1f months", months))
    )


def calculator(
    workloads: DataFrame, curve: DataFrame, api_price: float, fixed: float = pr.FIXED_MONTHLY,
    marginal: float = pr.MARGINAL_PER_QUERY, too_few: int = 100,
) -> DataFrame:
    """Cost-only verdict per workload (and month, if given), with interpolated quality and the label payback time."""
    q = F.col("queries")
    api, own = q * api_price, fixed + q * marginal
    months = F.when(api > own, F.col("n_labels") * pr.COST_PER_LABEL / (api - own))
    verdict = (
        F.when(F.col("n_labels") < too_few, "too_few_labels").when(api <= own, "api").otherwise("self_host")
    )
    return _with_curve(workloads, curve).select(
        *_row_keys(workloads), "n_labels", "queries",
        F.round(interpolated_quality("n_labels"), 6).alias("macro_f1"),
        F.round(api, 4).alias("api_usd"),
        F.round(own, 4).alias("self_host_usd"),
        F.lit(int(fixed // (api_price - marginal))).cast("bigint").alias("breakeven_queries"),
        verdict.alias("verdict"),
        F.when(verdict == "self_host", payback_text(months)).alias("payback"),
    )
