"""Windowed log and metric features."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.functions.expressions import auth_failure, status_in_class
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.operators.skew import BLOCK_ROWS
from tidewatch.schema import LOG_FEATURES, METRIC_FEATURES

WINDOW = "5 minutes"
LOG_KEYS = ("source", "host", "window_start")


def with_window(df: DataFrame, window: str = WINDOW, ts: str = "ts") -> DataFrame:
    """Tumbling window start; rows whose time did not parse are dropped."""
    return df.where(F.col(ts).isNotNull()).withColumn("window_start", F.window(ts, window)["start"])


def _entropy(total, c_log_c):
    """Shannon entropy in bits from the total count and the sum of c*log2(c)."""
    h = F.log2(total) - c_log_c / total
    return F.when(total > 1, F.greatest(h, F.lit(0.0))).otherwise(F.lit(0.0))


def log_window_counts(events: DataFrame, window: str = WINDOW) -> DataFrame:
    """Every log feature but the latency percentiles, in one scan.

    Each event gives one row per counted dimension.  Counting per (key,
    dimension, value) first spreads a hot key over its values and makes exact
    distinct counts and entropies a combinable second step.
    """
    e = with_window(events, window)
    path = F.coalesce(F.col("path"), F.lit(""))
    measures = {
        "m4": F.when(status_in_class(F.col("status"), 4), 1).otherwise(0),
        "m5": F.when(status_in_class(F.col("status"), 5), 1).otherwise(0),
        "auth": F.when(auth_failure(F.col("severity"), path), 1).otherwise(0),
        "bytes_sum": F.col("bytes").cast("double"),
        "bytes_n": F.when(F.col("bytes").isNotNull(), 1).otherwise(0),
    }
    blank = [F.lit(None).cast("double" if n == "bytes_sum" else "int").alias(n) for n in measures]
    dims = F.array(
        F.struct(F.lit("path").alias("dim"), path.alias("val"), *[c.alias(n) for n, c in measures.items()]),
        F.struct(F.lit("ip").alias("dim"), F.col("src_ip").alias("val"), *blank),
        F.struct(F.lit("ua").alias("dim"), F.col("user_agent").alias("val"), *blank),
    )
    rows = e.select("source", F.coalesce("host", F.lit("")).alias("host"), "window_start", F.inline(dims))
    rows = rows.where((F.col("dim") == "path") | ((F.col("val").isNotNull()) & (F.col("val") != "")))
    counts = rows.groupBy(*LOG_KEYS, "dim", "val").agg(
        F.count(F.lit(1)).alias("c"), *[F.sum(n).alias(n) for n in measures]
    )

    def dim(name, expr):
        return F.when(F.col("dim") == name, expr)

    c_log_c = F.col("c") * F.log2(F.col("c"))
    per_window = counts.groupBy(*LOG_KEYS).agg(
        F.sum(dim("path", F.col("c"))).alias("n"),
        F.coalesce(F.sum(dim("ip", F.col("c"))), F.lit(0)).alias("n_ip"),
        F.sum(dim("path", c_log_c)).alias("h_path"),
        F.sum(dim("ip", c_log_c)).alias("h_ip"),
        F.count(dim("path", F.lit(1))).alias("d_path"),
        F.count(dim("ip", F.lit(1))).alias("d_ip"),
        F.count(dim("ua", F.lit(1))).alias("d_ua"),
        *[F.sum(n).alias(n) for n in measures],
    )
    n = F.col("n")
    return per_window.select(
        *LOG_KEYS,
        n.cast("double").alias("request_count"),
        (F.col("m4") / n).alias("rate_4xx"),
        (F.col("m5") / n).alias("rate_5xx"),
        F.col("d_ip").cast("double").alias("distinct_ips"),
        F.col("d_path").cast("double").alias("distinct_paths"),
        (F.col("auth") / n).alias("auth_failure_rate"),
        F.coalesce(F.try_divide("bytes_sum", "bytes_n"), F.lit(0.0)).alias("avg_bytes"),
        _entropy(n, F.col("h_path")).alias("entropy_path"),
        _entropy(F.col("n_ip"), F.col("h_ip")).alias("entropy_src_ip"),
        F.col("d_ua").cast("double").alias("user_agent_distinct"),
    )


def log_window_latency(events: DataFrame, window: str = WINDOW, hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """p50 and p99 latency of every (source, host, window) that has any latency."""
    e = with_window(events, window)
    e = e.select("source", F.coalesce("host", F.lit("")).alias("host"), "window_start", "latency_ms")
    return exact_percentiles(e, LOG_KEYS, "latency_ms", {"p99_latency_ms": 0.99, "p50_latency_ms": 0.5}, hot_rows)


def log_window_features(events: DataFrame, window: str = WINDOW, hot_rows: int = BLOCK_ROWS) -> DataFrame:
    """The twelve log features per (source, host, window)."""
    out = log_window_counts(events, window).join(
        log_window_latency(events, window, hot_rows), list(LOG_KEYS), "left"
    )
    return out.select(*LOG_KEYS, *[F.coalesce(F.col(f), F.lit(0.0)).alias(f) for f in LOG_FEATURES])


def metric_window_stats(
    samples: DataFrame, keys: Sequence[str] = ("host", "metric"), window: str = WINDOW, hot_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Percentiles, maximum and least-squares slope (per second) per series and window.

    Time is centred on the window start before fitting, which keeps the sums
    small enough for doubles.
    """
    s = samples.withColumn("value", F.expr("try_cast(value AS double)")).where(F.col("value").isNotNull())
    s = with_window(s, window)
    for k in keys:
        s = s.withColumn(k, F.coalesce(k, F.lit("")))
    group = [*keys, "window_start"]
    offset = (F.unix_micros("ts") - F.unix_micros("window_start")) / F.lit(1e6)
    base = s.groupBy(*group).agg(
        F.max("value").alias("value_max"),
        F.coalesce(F.regr_slope(F.col("value"), offset), F.lit(0.0)).alias("slope"),
    )
    quantiles = exact_percentiles(
        s, group, "value", {"value_p50": 0.5, "value_p95": 0.95, "value_p99": 0.99}, hot_rows
    )
    return base.join(quantiles, group)


def metric_window_features(
    samples: DataFrame, keys: Sequence[str] = ("host", "metric"), window: str = WINDOW, hot_rows: int = BLOCK_ROWS
) -> DataFrame:
    """The six metric features; ``delta_p50`` compares with the previous present window."""
    stats = metric_window_stats(samples, keys, window, hot_rows)
    series = Window.partitionBy(*keys).orderBy("window_start")
    previous = F.lag("value_p50").over(series)
    stats = stats.withColumn("delta_p50", F.col("value_p50") - F.coalesce(previous, F.col("value_p50")))
    return stats.select(*keys, "window_start", *METRIC_FEATURES)


def feature_records(features: DataFrame) -> DataFrame:
    """Feature-store form: ``feature_key``, ``feature_timestamp`` and the feature columns."""
    key = F.concat_ws("|", "source", "host", F.date_format("window_start", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    rest = [c for c in features.columns if c not in LOG_KEYS]
    return features.select(key.alias("feature_key"), F.col("window_start").alias("feature_timestamp"), *rest)


def distinct_addresses(events: DataFrame, window: str = "1 minute", key: str = "edge:all:distinct_src_ips") -> DataFrame:
    """Distinct source addresses per window as samples for the count rule.

    Addresses are deduplicated per window first; the count is then combinable,
    so a flood in one minute is spread over its addresses.
    """
    e = with_window(events, window).where(F.coalesce("src_ip", F.lit("")) != "").select("window_start", "src_ip")
    n = e.distinct().groupBy(F.col("window_start").alias("ts")).agg(F.count(F.lit(1)).cast("double").alias("value"))
    return n.select(F.lit(key).alias("metric_key"), "value", "ts", F.unix_seconds("ts").alias("event_id"))
