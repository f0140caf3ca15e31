"""Queries of telemetry: latency, request counts, rings, rate limits, windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analysis as A
from . import query, table


@query("a10_latency_summary", "SELECT event_type, count(*) AS n, round(avg(value), 4) AS mean, round(min(value), 4) AS low, round(max(value), 4) AS high, round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY event_type")
def a10(spark, d):
    return A.latency_summary(table(spark, d, "events"), ["event_type"], "value")


@query("a12_request_counts", "SELECT event_type, user_id % 10 AS scope, count(*) AS n, round(avg(value), 6) AS mean, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY ALL")
def a12(spark, d):
    return table(spark, d, "events").groupBy("event_type", (F.col("user_id") % 10).alias("scope")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


@query("a13_telemetry_ring", "SELECT event_type, max(total) AS total, count(*) AS sampled, round(avg(value), 6) AS mean, max(value) AS high FROM (SELECT *, count(*) OVER (PARTITION BY event_type) AS total, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k <= 1000 GROUP BY event_type")
def a13(spark, d):
    out = A.ring(table(spark, d, "events"), ["event_type"], ["ts", "event_id"], "value")
    return out.select("event_type", "total", "sampled", F.round("mean", 6).alias("mean"), "high")


@query("w14_trailing_count", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) AS in_window, count(*) OVER (PARTITION BY user_id ORDER BY epoch(date_trunc('second', ts))::BIGINT RANGE BETWEEN 3600 PRECEDING AND CURRENT ROW) <= 3 AS allowed FROM events")
def w14(spark, d):
    return A.trailing_count(table(spark, d, "events"), ["user_id"], 3600, 3).select("event_id", "in_window", "allowed")


@query("z10_windows", "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def z10(spark, d):
    return table(spark, d, "events").groupBy(F.window(F.col("ts"), "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")


@query("z11_sessions", "WITH s AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE OR lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL THEN 1 ELSE 0 END AS b FROM events), g AS (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM s) SELECT user_id, min(ts) AS start, count(*) AS n FROM g GROUP BY user_id, k")
def z11(spark, d):
    return table(spark, d, "events").groupBy(F.session_window(F.col("ts"), "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "n")
