"""Fixed schemas of the event, anomaly and alert tables."""

from __future__ import annotations

from pyspark.sql import types as T

# The fourteen source names of the common event model.
SOURCES = (
    "cloudfront", "alb", "waf", "app", "eks", "nginx", "kafka", "mysql", "mongodb", "redis",
    "node-metrics", "container-metrics", "prometheus", "otel-traces",
)
METRIC_SOURCES = ("node-metrics", "container-metrics", "prometheus")
# Fixed value: longest message kept in an event.
MESSAGE_LIMIT = 4000
# Labels an analyst may give to an alert.
ALERT_LABELS = ("true_positive", "false_positive", "ignored")

EVENT = T.StructType([
    T.StructField("ts", T.TimestampType()),
    T.StructField("ts_raw", T.StringType()),
    T.StructField("ingest_ts", T.TimestampType()),
    T.StructField("source", T.StringType()),
    T.StructField("host", T.StringType()),
    T.StructField("severity", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("latency_ms", T.DoubleType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("src_ip", T.StringType()),
    T.StructField("user", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("user_agent", T.StringType()),
    T.StructField("message", T.StringType()),
    T.StructField("attrs", T.StringType()),
])

ANOMALY = T.StructType([
    T.StructField("detector", T.StringType()),
    T.StructField("metric_key", T.StringType()),
    T.StructField("ts_seen", T.DoubleType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("explanation", T.StringType()),
])

ALERT = T.StructType(
    ANOMALY.fields
    + [
        T.StructField("id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("severity", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("label", T.StringType()),
        T.StructField("raw_event", T.StringType()),
    ]
)

LOG_FEATURES = (
    "request_count", "rate_4xx", "rate_5xx", "distinct_ips", "distinct_paths", "auth_failure_rate",
    "p99_latency_ms", "p50_latency_ms", "avg_bytes", "entropy_path", "entropy_src_ip",
    "user_agent_distinct",
)
METRIC_FEATURES = ("value_p50", "value_p95", "value_p99", "value_max", "delta_p50", "slope")
