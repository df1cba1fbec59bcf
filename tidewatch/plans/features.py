"""Registered queries: windowed features."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.expressions import auth_failure, status_in_class
from tidewatch.operators import features as ops
from tidewatch.operators.joins import latest_before
from tidewatch.plans.views import COMMON_EVENTS_SQL, common_events, rounded, table
from tidewatch.schema import LOG_FEATURES
from tidewatch.session import settle

HOUR = "1 hour"
DAY = "1 day"


def samples(spark, sf):
    e = table(spark, sf, "events")
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("concat('node-', user_id % 10)").alias("host"),
        F.col("event_type").alias("metric"),
        "value",
    )


SAMPLES_SQL = """
samples AS (SELECT event_id, ts, 'node-' || (user_id % 10) AS host, event_type AS metric, value FROM events)"""

LOG_BASE_SQL = f"""
WITH {COMMON_EVENTS_SQL},
w AS (SELECT *, time_bucket(INTERVAL '1 day', ts) AS window_start, coalesce(path, '') AS p,
        nullif(src_ip, '') AS ip, nullif(user_agent, '') AS ua FROM common_events),
base AS (
  SELECT source, host, window_start, count(*) AS n,
    count(*) FILTER (status >= 400 AND status < 500) AS n4,
    count(*) FILTER (status >= 500 AND status < 600) AS n5,
    count(DISTINCT ip) AS d_ip, count(DISTINCT p) AS d_path, count(DISTINCT ua) AS d_ua,
    count(*) FILTER (severity IN ('ERROR', 'WARN') AND regexp_matches(p, 'login|auth|signin|logon|token')) AS n_auth,
    quantile_cont(latency_ms, 0.99) AS p99, quantile_cont(latency_ms, 0.5) AS p50, avg(bytes) AS ab
  FROM w GROUP BY ALL),
ent_path AS (
  SELECT source, host, window_start, CASE WHEN sum(c) > 1 THEN log2(sum(c)) - sum(c * log2(c)) / sum(c) ELSE 0 END AS h
  FROM (SELECT source, host, window_start, p, count(*) AS c FROM w GROUP BY ALL) GROUP BY ALL),
ent_ip AS (
  SELECT source, host, window_start, CASE WHEN sum(c) > 1 THEN log2(sum(c)) - sum(c * log2(c)) / sum(c) ELSE 0 END AS h
  FROM (SELECT source, host, window_start, ip, count(*) AS c FROM w WHERE ip IS NOT NULL GROUP BY ALL) GROUP BY ALL),
feats AS (
  SELECT b.source, b.host, b.window_start,
    CAST(n AS DOUBLE) AS request_count, n4 / n AS rate_4xx, n5 / n AS rate_5xx,
    CAST(d_ip AS DOUBLE) AS distinct_ips, CAST(d_path AS DOUBLE) AS distinct_paths, n_auth / n AS auth_failure_rate,
    coalesce(p99, 0) AS p99_latency_ms, coalesce(p50, 0) AS p50_latency_ms, coalesce(ab, 0) AS avg_bytes,
    greatest(ep.h, 0) AS entropy_path, greatest(coalesce(ei.h, 0), 0) AS entropy_src_ip,
    CAST(d_ua AS DOUBLE) AS user_agent_distinct
  FROM base b JOIN ent_path ep USING (source, host, window_start)
  LEFT JOIN ent_ip ei USING (source, host, window_start))"""

METRIC_BASE_SQL = f"""
WITH {SAMPLES_SQL},
w AS (SELECT *, time_bucket(INTERVAL '1 hour', ts) AS window_start FROM samples),
stats AS (
  SELECT host, metric, window_start, quantile_cont(value, 0.5) AS value_p50, quantile_cont(value, 0.95) AS value_p95,
    quantile_cont(value, 0.99) AS value_p99, max(value) AS value_max,
    CASE WHEN count(*) > 1 THEN coalesce(regr_slope(value, (epoch_us(ts) - epoch_us(window_start)) / 1e6), 0) ELSE 0 END AS slope
  FROM w GROUP BY ALL),
feats AS (
  SELECT *, value_p50 - coalesce(lag(value_p50) OVER (PARTITION BY host, metric ORDER BY window_start), value_p50) AS delta_p50
  FROM stats)"""


_LATENCY = ("p99_latency_ms", "p50_latency_ms")


def _log(cols):
    # Features without percentiles need the counting scan only.
    build = ops.log_window_features if set(cols) & set(_LATENCY) else ops.log_window_counts

    def run(spark, sf):
        return rounded(build(common_events(spark, sf), DAY).select("source", "host", "window_start", *cols))

    return run


def _log_sql(cols):
    picked = ", ".join(f"round({c}, 6) AS {c}" for c in cols)
    return f"{LOG_BASE_SQL} SELECT source, host, window_start, {picked} FROM feats"


def a01_window_buckets(spark, sf):
    e = ops.with_window(common_events(spark, sf), "5 minutes")
    return rounded(e.groupBy("source", "host", "window_start").agg(F.count(F.lit(1)).alias("n")))


def a13_window_slope(spark, sf):
    out = ops.metric_window_stats(samples(spark, sf), window=HOUR)
    return rounded(out.select("host", "metric", "window_start", "slope"))


def a12_metric_window_stats(spark, sf):
    out = ops.metric_window_stats(samples(spark, sf), window=HOUR)
    return rounded(out.drop("slope"))


def a14_metric_window_features(spark, sf):
    return rounded(ops.metric_window_features(samples(spark, sf), window=HOUR))


def w01_delta_p50(spark, sf):
    out = ops.metric_window_features(samples(spark, sf), window=HOUR)
    return rounded(out.select("host", "metric", "window_start", "delta_p50"))


def p02_status_classes(spark, sf):
    e = common_events(spark, sf)
    return e.select(
        "event_id",
        status_in_class(F.col("status"), 4).alias("is_4xx"),
        status_in_class(F.col("status"), 5).alias("is_5xx"),
    )


def p03_auth_failures(spark, sf):
    e = common_events(spark, sf)
    return e.where(auth_failure(F.col("severity"), F.col("path"))).select("event_id", "severity", "path")


def p04_parsed_time_only(spark, sf):
    """Times rendered as ISO text, every seventh one spoiled, parsed back."""
    e = common_events(spark, sf)
    text = F.expr("CASE WHEN k % 7 = 0 THEN concat('t', event_id) ELSE date_format(ts, \"yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'\") END")
    parsed = e.select("event_id", F.try_to_timestamp(text).alias("ts"))
    return rounded(parsed.where(F.col("ts").isNotNull()))


def p05_numeric_values_only(spark, sf):
    """Metric values as text, every ninth one not a number."""
    e = common_events(spark, sf)
    text = F.expr("CASE WHEN k % 9 = 0 THEN 'n/a' ELSE CAST(raw_value AS string) END")
    v = e.select("event_id", text.alias("t")).select("event_id", F.expr("try_cast(t AS double)").alias("value"))
    return v.where(F.col("value").isNotNull())


def k09_feature_records(spark, sf):
    out = ops.feature_records(ops.log_window_features(common_events(spark, sf), DAY))
    return rounded(out)


def j04_previous_window_p50(spark, sf):
    stats = settle(ops.metric_window_stats(samples(spark, sf), window=HOUR).select("host", "metric", "window_start", "value_p50"))
    # Previous present window of the series, found as an as-of join on the window start.
    left = stats.select("host", "metric", F.col("window_start").alias("ts"), "value_p50")
    right = stats.select("host", "metric", F.col("window_start").alias("ts"), F.col("value_p50").alias("previous_p50"))
    out = latest_before(left, right, ["host", "metric"], "ts", ["previous_p50"], strict=True)
    return rounded(out.withColumnRenamed("ts", "window_start"))


_ONE = {
    "a02_request_count": ["request_count"],
    "a03_error_rates": ["rate_4xx", "rate_5xx"],
    "a04_distinct_ips": ["distinct_ips"],
    "a05_distinct_paths": ["distinct_paths"],
    "a06_auth_failure_rate": ["auth_failure_rate"],
    "a07_latency_percentiles": ["p99_latency_ms", "p50_latency_ms"],
    "a08_avg_bytes": ["avg_bytes"],
    "a09_entropies": ["entropy_path", "entropy_src_ip"],
    "a10_user_agents": ["user_agent_distinct"],
    "a11_log_window_features": list(LOG_FEATURES),
}

QUERIES = {name: _log(cols) for name, cols in _ONE.items()}
QUERIES.update({
    "a01_window_buckets": a01_window_buckets,
    "a12_metric_window_stats": a12_metric_window_stats,
    "a13_window_slope": a13_window_slope,
    "a14_metric_window_features": a14_metric_window_features,
    "w01_delta_p50": w01_delta_p50,
    "j04_previous_window_p50": j04_previous_window_p50,
    "p02_status_classes": p02_status_classes,
    "p03_auth_failures": p03_auth_failures,
    "p04_parsed_time_only": p04_parsed_time_only,
    "p05_numeric_values_only": p05_numeric_values_only,
    "k09_feature_records": k09_feature_records,
})

_M = "host, metric, window_start"
ORACLES = {name: _log_sql(cols) for name, cols in _ONE.items()}
ORACLES.update({
    "a01_window_buckets": f"WITH {COMMON_EVENTS_SQL} SELECT source, host, time_bucket(INTERVAL '5 minutes', ts) AS window_start, count(*) AS n FROM common_events GROUP BY ALL",
    "a12_metric_window_stats": f"{METRIC_BASE_SQL} SELECT {_M}, round(value_p50, 6) AS value_p50, round(value_p95, 6) AS value_p95, round(value_p99, 6) AS value_p99, round(value_max, 6) AS value_max FROM stats",
    "a13_window_slope": f"{METRIC_BASE_SQL} SELECT {_M}, round(slope, 6) + 0.0 AS slope FROM stats",
    "a14_metric_window_features": f"{METRIC_BASE_SQL} SELECT {_M}, round(value_p50, 6) AS value_p50, round(value_p95, 6) AS value_p95, round(value_p99, 6) AS value_p99, round(value_max, 6) AS value_max, round(delta_p50, 6) + 0.0 AS delta_p50, round(slope, 6) + 0.0 AS slope FROM feats",
    "w01_delta_p50": f"{METRIC_BASE_SQL} SELECT {_M}, round(delta_p50, 6) + 0.0 AS delta_p50 FROM feats",
    "j04_previous_window_p50": f"{METRIC_BASE_SQL} SELECT {_M}, round(value_p50, 6) AS value_p50, round(lag(value_p50) OVER (PARTITION BY host, metric ORDER BY window_start), 6) AS previous_p50 FROM stats",
    "p02_status_classes": f"WITH {COMMON_EVENTS_SQL} SELECT event_id, status >= 400 AND status < 500 AS is_4xx, status >= 500 AND status < 600 AS is_5xx FROM common_events",
    "p03_auth_failures": f"WITH {COMMON_EVENTS_SQL} SELECT event_id, severity, path FROM common_events WHERE severity IN ('ERROR', 'WARN') AND regexp_matches(path, 'login|auth|signin|logon|token')",
    "p04_parsed_time_only": f"WITH {COMMON_EVENTS_SQL} SELECT event_id, ts FROM common_events WHERE k % 7 <> 0",
    "p05_numeric_values_only": f"WITH {COMMON_EVENTS_SQL} SELECT event_id, raw_value AS value FROM common_events WHERE k % 9 <> 0",
    "k09_feature_records": f"{LOG_BASE_SQL} SELECT concat_ws('|', source, host, strftime(window_start, '%Y-%m-%dT%H:%M:%SZ')) AS feature_key, window_start AS feature_timestamp, "
    + ", ".join(f"round({c}, 6) AS {c}" for c in LOG_FEATURES) + " FROM feats",
})
