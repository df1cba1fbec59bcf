"""Service levels, error budgets, freshness and request histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import exact_percentiles, rolling_percentiles
from tidewatch.operators.skew import trailing_sums

# Availability target, budget period and (seconds, share of budget, action) per horizon.
AVAILABILITY = 0.995
SLO_DAYS = 30
BUDGET_SECONDS = SLO_DAYS * 86400
BURN_HORIZONS = ((3600, 0.02, "page"), (6 * 3600, 0.05, "page"), (3 * 86400, 0.10, "ticket"))
# Upper edges (seconds) of the request latency histogram.
LATENCY_EDGES = (0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0)


def service_levels(requests: DataFrame) -> DataFrame:
    """p99 latency, availability (answers below 500 over all) and error rate per service."""
    ok = F.count_if((F.col("status") >= 200) & (F.col("status") < 300) | (F.col("status") >= 400) & (F.col("status") < 500))
    bad = F.count_if(F.col("status") >= 500)
    base = requests.groupBy("service").agg(
        F.count(F.lit(1)).alias("requests"), (ok / F.count(F.lit(1))).alias("availability"), (bad / F.count(F.lit(1))).alias("error_rate"))
    return base.join(exact_percentiles(requests, ["service"], "latency_ms", {"p99_latency_ms": 0.99}), "service", "left")


def rolling_service_levels(requests: DataFrame, days: int = SLO_DAYS) -> DataFrame:
    """Service levels over the trailing ``days`` of each day with requests: (service, day, requests, availability, error_rate, p99_latency_ms).

    Everything is built from counts per service and day (and value slice), so a window costs as much as its days, not its rows.
    """
    rows = requests.withColumn("_d", F.unix_date(F.to_date("ts")).cast("long"))
    good = F.col("status").between(200, 299) | F.col("status").between(400, 499)
    daily = rows.groupBy("service", "_d").agg(F.count(F.lit(1)).alias("n"), F.count_if(good).alias("ok"), F.count_if(F.col("status") >= 500).alias("bad"))
    trailing = Window.partitionBy("service").orderBy("_d").rangeBetween(-(days - 1), 0)
    n, ok, bad = (F.sum(c).over(trailing) for c in ("n", "ok", "bad"))
    levels = daily.select("service", "_d", n.alias("requests"), (ok / n).alias("availability"), (bad / n).alias("error_rate"))
    slow = rolling_percentiles(rows, ["service"], "_d", "latency_ms", {"p99_latency_ms": 0.99}, days)
    return levels.join(slow, ["service", "_d"], "left").select(
        "service", F.date_from_unix_date(F.col("_d").cast("int")).alias("day"), "requests", "availability", "error_rate", "p99_latency_ms")


def error_budget_burn(requests: DataFrame, horizons=BURN_HORIZONS, availability: float = AVAILABILITY) -> DataFrame:
    """Share of the 30-day budget burned in each trailing horizon, per service and minute.

    Counts per minute come first; the frames then see at most one row per
    minute and service, and trailing sums are differences of running sums.
    """
    minute = (F.floor(F.unix_seconds("ts") / 60) * 60).alias("second")
    per = requests.groupBy("service", minute).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("bad"))
    cells = []
    for seconds, share, action in horizons:
        sums = trailing_sums(["service"], "second", seconds - 60, {f"bad{seconds}": "bad", f"n{seconds}": "n"})
        cells.append((seconds, share, action, sums))
    wide = per.select("service", "second", *[c.alias(k) for _, _, _, sums in cells for k, c in sums.items()])
    wide = wide.select("service", "second", *[
        (F.col(f"bad{s}") / F.col(f"n{s}") / (1 - availability) * (s / BUDGET_SECONDS)).alias(f"b{s}") for s, _, _, _ in cells])
    rows = F.inline(F.array(*[
        F.struct(F.lit(s).alias("horizon_seconds"), F.col(f"b{s}").alias("burned"), F.lit(a).alias("action"),
                 (F.col(f"b{s}") >= share).alias("breach")) for s, share, a, _ in cells]))
    return wide.select("service", "second", rows)


def freshness(events: DataFrame) -> DataFrame:
    """Largest delay between event and ingest time per source and minute, in seconds."""
    lag = (F.unix_micros("ingest_ts") - F.unix_micros("ts")) / F.lit(1e6)
    return events.groupBy("source", F.window("ingest_ts", "1 minute")["start"].alias("minute")).agg(F.max(lag).alias("max_lag_s"))


def requests_by_status(requests: DataFrame) -> DataFrame:
    return requests.groupBy("route", "status").agg(F.count(F.lit(1)).alias("n"))


def latency_histogram(requests: DataFrame, edges: Sequence[float] = LATENCY_EDGES) -> DataFrame:
    """Cumulative counts (route, le, n) with a closing +Inf bucket; one wide aggregate, no row expansion."""
    seconds = F.col("latency_ms") / 1000
    counts = [F.count_if(seconds <= e).alias(f"_{i}") for i, e in enumerate(edges)]
    wide = requests.where(F.col("latency_ms").isNotNull()).groupBy("route").agg(*counts, F.count(F.lit(1)).alias("_inf"))
    cells = [F.struct(F.lit(str(e)).alias("le"), F.col(f"_{i}").alias("n")) for i, e in enumerate(edges)]
    return wide.select("route", F.inline(F.array(*cells, F.struct(F.lit("+Inf").alias("le"), F.col("_inf").alias("n")))))


def precision_pause(alerts: DataFrame, floor: float = 0.90, days: int = 7) -> DataFrame:
    """Daily precision per detector and whether it stayed below ``floor`` for ``days`` days in a row."""
    day = F.date_trunc("day", "created_at").alias("day")
    tp, fp = F.count_if(F.col("label") == "true_positive"), F.count_if(F.col("label") == "false_positive")
    daily = alerts.groupBy("detector", day).agg(tp.alias("tp"), fp.alias("fp")).where(F.col("tp") + F.col("fp") > 0)
    daily = daily.withColumn("precision", F.col("tp") / (F.col("tp") + F.col("fp"))).withColumn("d", F.unix_date(F.to_date("day")))
    w = Window.partitionBy("detector").orderBy("d").rangeBetween(-(days - 1), 0)
    low = (F.max("precision").over(w) < floor) & (F.count(F.lit(1)).over(w) >= days)
    return daily.select("detector", "day", "precision", F.min("precision").over(w).alias("week_min"), low.alias("pause"))
