"""Request-log metrics, latency percentiles, health verdict, load-test summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from netsift.functions.scaling import bucket_index, quantiles, running_sums


def percentile_by_index(df: DataFrame, value: str, percents: list[float], by: list[str] = (), nearest_rank: bool = False, segments: int = 64) -> DataFrame:
    """Order statistic at position floor(n * p / 100) (capped), or the nearest rank ceil(n * p / 100).

    Values are counted, the counts summed along the values in ranges, and the row that covers the
    wanted position is kept: no group is sorted in one task.
    """
    cuts = df.agg(F.percentile_approx(value, [i / segments for i in range(1, segments)], 1_000)).first()[0] or []
    keys = list(by)
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n"))
    cum = running_sums(counts.withColumn("seg", bucket_index(F.col(value), sorted(set(cuts)))), keys, "seg", [value], {"c": "n"})
    if keys:
        placed = cum.join(counts.groupBy(*keys).agg(F.sum("n").alias("total")), keys)
    else:
        placed = cum.withColumn("total", F.lit(counts.agg(F.sum("n")).first()[0] or 0))
    n = F.col("total")
    out = []
    for p in percents:
        pos = F.ceil(n * p / 100.0) - 1 if nearest_rank else F.floor(n * p / 100.0)
        pos = F.greatest(F.least(pos, n - 1), F.lit(0))
        out.append(F.max(F.when((pos >= F.col("c") - F.col("n")) & (pos < F.col("c")), F.col(value))).alias(f"p{p:g}"))
    return placed.groupBy(*keys).agg(*out)


def metrics(df: DataFrame, now_us: int, retention_s: float = 300.0, start_us: int | None = None, success: Column | None = None,
            rate_limited: int = 0) -> DataFrame:
    """One row: totals over the log, average and percentile latency inside the retention time, rate since start.

    `success` defaults to "every request that came back": only exceptions count as failures there, so
    pass e.g. status < 500 to count server errors.
    """
    ok = F.lit(True) if success is None else success
    is_recent = F.col("ts_us") > now_us - int(retention_s * 1e6)
    p = percentile_by_index(df.where(is_recent), "latency_ms", [95, 99]).first()  # two numbers
    elapsed = (F.lit(now_us) - (F.lit(start_us) if start_us is not None else F.min("ts_us"))) / 1e6
    return df.agg(
        F.count("*").alias("total_requests"), F.count_if(ok).alias("successful_requests"), F.count_if(~ok).alias("failed_requests"),
        F.coalesce(F.avg(F.when(is_recent, F.col("latency_ms"))), F.lit(0.0)).alias("avg_latency_ms"), F.lit(float(p["p95"] or 0.0)).alias("p95_latency_ms"),
        F.lit(float(p["p99"] or 0.0)).alias("p99_latency_ms"), F.when(elapsed > 0, F.count("*") / elapsed).otherwise(0.0).alias("requests_per_second"),
        F.lit(rate_limited).alias("rate_limited_requests"))


def windowed_metrics(df: DataFrame, seconds: int = 300, success: Column | None = None) -> DataFrame:
    """Totals and average latency per event-time window; `ts` is a timestamp. Works on streams."""
    ok = F.lit(True) if success is None else success
    return df.groupBy(F.window("ts", f"{seconds} seconds").alias("w")).agg(
        F.count("*").alias("total_requests"), F.count_if(ok).alias("successful_requests"), F.count_if(~ok).alias("failed_requests"),
        F.avg("latency_ms").alias("avg_latency_ms"))


def health_verdict(per_service: DataFrame) -> DataFrame:
    """Adds status and error rate; needs breaker state, total, successful and failed counts."""
    bad = (F.col("circuit_state") == "open") | (F.col("failed_requests") > F.col("successful_requests") * 0.1)
    return per_service.withColumn("status", F.when(bad, "degraded").otherwise("healthy")).withColumn(
        "error_rate", F.when(F.col("total_requests") > 0, F.col("failed_requests") / F.col("total_requests")).otherwise(0.0))


def latest_state(decided: DataFrame, service: str, ts: str, order: list[str]) -> DataFrame:
    """Breaker state after each service's last call."""
    return decided.groupBy(service).agg(F.max_by("state_after", F.struct(ts, *order)).alias("circuit_state"))


def load_summary(df: DataFrame, failed: Column) -> DataFrame:
    """Requests, failures, ratio, average, median, p95, p99 and requests per second of a load test."""
    q = quantiles(df, ["latency_ms"], [0.5, 0.95, 0.99])["latency_ms"]
    span = (F.max("ts_us") - F.min("ts_us")) / 1e6
    return df.agg(
        F.count("*").alias("requests"), F.count_if(failed).alias("failures"), (F.count_if(failed) / F.count("*")).alias("fail_ratio"),
        F.avg("latency_ms").alias("avg_ms"), F.lit(q[0]).alias("median_ms"), F.lit(q[1]).alias("p95_ms"), F.lit(q[2]).alias("p99_ms"),
        F.try_divide(F.count("*").cast("double"), span).alias("rps"))

