"""Registered queries: rule streams in batch form."""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators import rules as R
from tidewatch.operators.features import distinct_addresses
from tidewatch.operators.skew import row_blocks
from tidewatch.plans.views import COMMON_EVENTS_SQL, common_events, rounded, table

SAMPLES_SQL = f"""
{COMMON_EVENTS_SQL},
samples AS (
  SELECT * FROM (
    SELECT event_id, ts,
      CASE WHEN source IN ('node-metrics', 'container-metrics', 'prometheus') AND metric_value IS NOT NULL
             THEN concat_ws(':', source, host, metric)
           WHEN latency_ms IS NOT NULL THEN concat_ws(':', source, host, 'latency_ms')
           WHEN status IS NOT NULL THEN concat_ws(':', source, host, 'status_' || (status // 100) || 'xx') END AS metric_key,
      CASE WHEN source IN ('node-metrics', 'container-metrics', 'prometheus') AND metric_value IS NOT NULL THEN metric_value
           WHEN latency_ms IS NOT NULL THEN latency_ms ELSE 1.0 END AS value
    FROM common_events) WHERE metric_key IS NOT NULL)"""

Z_SQL = """
zw AS (SELECT *, avg(value) OVER f AS mean, stddev_samp(value) OVER f AS std, count(*) OVER f AS n FROM samples
  WINDOW f AS (PARTITION BY metric_key ORDER BY ts, event_id ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
zscore AS (SELECT event_id, metric_key, value, mean AS baseline, abs(value - mean) / std / 4.0 AS score
  FROM zw WHERE n >= 10 AND std > 0 AND abs(value - mean) / std >= 4.0)"""

EWMA_SQL = """
nb AS (SELECT *, row_number() OVER (PARTITION BY metric_key ORDER BY ts, event_id) AS n FROM samples),
fold AS (
  SELECT metric_key, n, event_id, value, value AS prev_mean, CAST(0 AS DOUBLE) AS prev_var,
    0.3 * value + 0.7 * value AS mean, 0.3 * (value - value) ** 2 AS var FROM nb WHERE n = 1
  UNION ALL
  SELECT b.metric_key, b.n, b.event_id, b.value, f.mean, f.var,
    CAST(0.3 AS DOUBLE) * b.value + CAST(0.7 AS DOUBLE) * f.mean,
    CAST(0.3 AS DOUBLE) * (b.value - f.mean) ** 2 + CAST(0.7 AS DOUBLE) * f.var
  FROM fold f JOIN nb b ON b.metric_key = f.metric_key AND b.n = f.n + 1),
ewma AS (SELECT event_id, metric_key, value, prev_mean AS baseline, abs(value - prev_mean) / (3.0 * sqrt(prev_var)) AS score
  FROM fold WHERE n >= 20 AND prev_var > 0 AND abs(value - prev_mean) > 3.0 * sqrt(prev_var))"""

ROC_SQL = """
lagged AS (SELECT *, lag(value) OVER (PARTITION BY metric_key ORDER BY ts, event_id) AS prev FROM samples),
roc AS (SELECT event_id, metric_key, value, prev AS baseline, (value - prev) / abs(prev) * 100 / 200.0 AS score
  FROM lagged WHERE prev IS NOT NULL AND prev <> 0 AND (value - prev) / abs(prev) * 100 >= 200.0)"""

STATIC_SQL = """
static AS (SELECT event_id, metric_key, value, CAST(0.05 AS DOUBLE) AS baseline, abs(value - 0.05) / 0.05 AS score
  FROM samples WHERE value > 0.05)"""

ALL_RULES_SQL = f"""{SAMPLES_SQL}, {Z_SQL}, {EWMA_SQL}, {ROC_SQL}, {STATIC_SQL},
anomalies AS (
  SELECT 1 AS rule_ord, 'zscore' AS detector, * FROM zscore UNION ALL
  SELECT 2, 'ewma', * FROM ewma UNION ALL
  SELECT 3, 'rate-of-change', * FROM roc UNION ALL
  SELECT 4, 'error-rate-static', * FROM static UNION ALL
  SELECT 5, 'ddos-distinct-ips', event_id, metric_key, value, 10000.0, value / 10000.0 FROM samples WHERE value > 10000)"""

_COLS = "event_id, detector, metric_key, round(value, 6) AS value, round(baseline, 6) AS baseline, round(score, 6) AS score"


def _samples(spark, sf):
    return R.samples_from_events(common_events(spark, sf))


def _run(rules):
    def go(spark, sf):
        out = R.apply_rules(_samples(spark, sf), rules())
        return rounded(out.select("event_id", "detector", "metric_key", "value", "baseline", "score"))

    return go


def p01_metric_samples(spark, sf):
    return rounded(_samples(spark, sf).select("event_id", "metric_key", "value"))


def w02_rolling_mean_std(spark, sf):
    b = row_blocks(_samples(spark, sf), ["metric_key"], "ts", ["ts", "event_id"], 59)
    w = Window.partitionBy("metric_key", "_block").orderBy("ts", "event_id").rowsBetween(-59, 0)
    out = b.select("event_id", "_halo", F.avg("value").over(w).alias("mean"), F.stddev_samp("value").over(w).alias("std"))
    return rounded(out.where(~F.col("_halo")).drop("_halo"), 8)


def w03_previous_value(spark, sf):
    b = row_blocks(_samples(spark, sf), ["metric_key"], "ts", ["ts", "event_id"], 1)
    w = Window.partitionBy("metric_key", "_block").orderBy("ts", "event_id")
    out = b.select("event_id", "_halo", "value", F.lag("value").over(w).alias("previous"))
    return rounded(out.where(~F.col("_halo")).drop("_halo"))


def a32_distinct_ips_per_minute(spark, sf):
    """The threshold of ten thousand is lowered to one, which the test data can reach."""
    out = R.apply_rules(distinct_addresses(common_events(spark, sf)), [R.DistinctCount("ddos-distinct-ips", threshold=1)])
    return rounded(out.select("detector", "ts", "value", "baseline", "score"))


def d05_distinct_count_rule(spark, sf):
    """Distinct users per day and event type against a threshold."""
    e = table(spark, sf, "events").select(F.window("ts", "1 day")["start"].cast("timestamp").alias("ts"), "event_type", "user_id")
    n = e.distinct().groupBy("ts", "event_type").agg(F.count(F.lit(1)).cast("double").alias("value"))
    s = n.select(F.concat(F.lit("users:"), "event_type").alias("metric_key"), "value", "ts", F.unix_seconds("ts").alias("event_id"))
    out = R.apply_rules(s, [R.DistinctCount("ddos-distinct-ips", threshold=40)])
    return rounded(out.select("detector", "metric_key", "ts", "value", "baseline", "score"))


MODELS = ("iforest-logs", "rcf-metrics", "trace-autoencoder", "log-embedding")


def model_scores(spark, sf):
    """Four model outputs per event derived from its payload; some answers are missing."""
    e = table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").cast("bigint").alias("k"))
    rows = F.inline(F.array(*[
        F.struct(F.lit(m).alias("model"), ((F.col("k") * (i + 3)) % 100 / 20.0).alias("score"), F.lit(i).alias("i"))
        for i, m in enumerate(MODELS)
    ]))
    s = e.select("event_id", "k", rows)
    answered = s.where((F.col("k") + F.col("i")) % 3 != 0)
    return answered.select("event_id", "model", "score", (F.col("score") >= 4.0).alias("is_anomaly"))


MODEL_SQL = """
k AS (SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
m AS (SELECT event_id, model, (k * (i + 3)) % 100 / 20.0 AS score
      FROM k, (VALUES ('iforest-logs', 0), ('rcf-metrics', 1), ('trace-autoencoder', 2), ('log-embedding', 3)) v(model, i)
      WHERE (k + i) % 3 <> 0)"""


def j07_model_fan_in(spark, sf):
    s = model_scores(spark, sf)
    per = s.groupBy("event_id").agg(
        F.max("score").alias("model_score"), F.min(F.when(F.col("is_anomaly"), F.col("model"))).alias("flagged"),
        F.count(F.lit(1)).alias("answers"))
    out = table(spark, sf, "events").select("event_id").join(per, "event_id", "left")
    return rounded(out.select("event_id", F.coalesce("model_score", F.lit(0.0)).alias("model_score"),
                              F.coalesce("flagged", F.lit("none")).alias("flagged"), F.coalesce("answers", F.lit(0)).alias("answers")))


_SCORED_RULES = [R.ZScore("zscore"), R.Ewma("ewma"), R.RateOfChange("rate-of-change")]


def d09_score_fusion(spark, sf):
    s = _samples(spark, sf)
    return rounded(R.fuse_scores(s, R.apply_rules(s, _SCORED_RULES), model_scores(spark, sf)))


@dataclass(frozen=True)
class Doubled(R.Rule):
    """A user-written rule: the value is at least twice the mean of the three before it."""

    @property
    def halo(self):
        return 3

    def frames(self, w):
        return {"mean": F.avg("value").over(w.rowsBetween(-3, -1))}

    def decide(self, value, frame):
        ratio = value / F.nullif(2 * frame["mean"], F.lit(0.0))
        return F.coalesce(ratio >= 1, F.lit(False)), frame["mean"], ratio


@dataclass(frozen=True)
class LongestRise(R.Rule):
    """A user-written fold: fires on the third rise in a row."""

    folds = True

    @property
    def halo(self):
        return 1_000

    def fold(self, values):
        up = (values.diff() > 0).astype(int)
        run = up.groupby((up == 0).cumsum()).cumsum()
        hit = run == 3
        return pd.DataFrame({"baseline": values.shift(3).where(hit), "score": run.where(hit).astype("float64")})


QUERIES = {
    "p01_metric_samples": p01_metric_samples,
    "w02_rolling_mean_std": w02_rolling_mean_std,
    "w03_previous_value": w03_previous_value,
    "d01_zscore_rule": _run(lambda: [R.ZScore("zscore")]),
    "d02_ewma_rule": _run(lambda: [R.Ewma("ewma")]),
    "d03_rate_of_change_rule": _run(lambda: [R.RateOfChange("rate-of-change")]),
    "d04_static_threshold_rule": _run(lambda: [R.StaticThreshold("error-rate-static")]),
    "d05_distinct_count_rule": d05_distinct_count_rule,
    "d06_rule_set": _run(R.default_rules),
    "u02_rule_anomaly_union": lambda spark, sf: R.apply_rules(_samples(spark, sf)).groupBy("rule_ord", "detector").agg(F.count(F.lit(1)).alias("n")),
    "a32_distinct_ips_per_minute": a32_distinct_ips_per_minute,
    "j07_model_fan_in": j07_model_fan_in,
    "d09_score_fusion": d09_score_fusion,
    "e01_user_column_rule": _run(lambda: [Doubled("doubled")]),
    "e02_user_fold_rule": _run(lambda: [LongestRise("three-rises")]),
}

ORACLES = {
    "p01_metric_samples": f"WITH {SAMPLES_SQL} SELECT event_id, metric_key, round(value, 6) AS value FROM samples",
    "w02_rolling_mean_std": f"WITH {SAMPLES_SQL}, {Z_SQL} SELECT event_id, round(mean, 8) AS mean, round(std, 8) AS std FROM zw",
    "w03_previous_value": f"WITH {SAMPLES_SQL}, {ROC_SQL} SELECT event_id, round(value, 6) AS value, round(prev, 6) AS previous FROM lagged",
    "d01_zscore_rule": f"WITH {SAMPLES_SQL}, {Z_SQL}, x AS (SELECT 'zscore' AS detector, * FROM zscore) SELECT {_COLS} FROM x",
    "d02_ewma_rule": f"WITH RECURSIVE {SAMPLES_SQL}, {EWMA_SQL}, x AS (SELECT 'ewma' AS detector, * FROM ewma) SELECT {_COLS} FROM x",
    "d03_rate_of_change_rule": f"WITH {SAMPLES_SQL}, {ROC_SQL}, x AS (SELECT 'rate-of-change' AS detector, * FROM roc) SELECT {_COLS} FROM x",
    "d04_static_threshold_rule": f"WITH {SAMPLES_SQL}, {STATIC_SQL}, x AS (SELECT 'error-rate-static' AS detector, * FROM static) SELECT {_COLS} FROM x",
    "d05_distinct_count_rule": "SELECT 'ddos-distinct-ips' AS detector, 'users:' || event_type AS metric_key, time_bucket(INTERVAL '1 day', ts) AS ts, CAST(count(DISTINCT user_id) AS DOUBLE) AS value, CAST(40 AS DOUBLE) AS baseline, round(count(DISTINCT user_id) / 40, 6) AS score FROM events GROUP BY event_type, time_bucket(INTERVAL '1 day', ts) HAVING count(DISTINCT user_id) > 40",
    "d06_rule_set": f"WITH RECURSIVE {ALL_RULES_SQL} SELECT {_COLS} FROM anomalies",
    "u02_rule_anomaly_union": f"WITH RECURSIVE {ALL_RULES_SQL} SELECT rule_ord, detector, count(*) AS n FROM anomalies GROUP BY ALL",
    "a32_distinct_ips_per_minute": f"WITH {COMMON_EVENTS_SQL} SELECT 'ddos-distinct-ips' AS detector, time_bucket(INTERVAL '1 minute', ts) AS ts, CAST(count(DISTINCT src_ip) AS DOUBLE) AS value, CAST(1 AS DOUBLE) AS baseline, CAST(count(DISTINCT src_ip) AS DOUBLE) AS score FROM common_events WHERE src_ip <> '' GROUP BY 2 HAVING count(DISTINCT src_ip) > 1",
    "j07_model_fan_in": f"WITH {MODEL_SQL} SELECT e.event_id, coalesce(max(score), 0) AS model_score, coalesce(min(model) FILTER (score >= 4.0), 'none') AS flagged, count(score) AS answers FROM events e LEFT JOIN m USING (event_id) GROUP BY 1",
    "d09_score_fusion": f"""WITH RECURSIVE {SAMPLES_SQL}, {Z_SQL}, {EWMA_SQL}, {ROC_SQL}, {MODEL_SQL},
      a AS (SELECT 1 AS o, 'zscore' AS detector, * FROM zscore UNION ALL SELECT 2, 'ewma', * FROM ewma UNION ALL SELECT 3, 'rate-of-change', * FROM roc),
      r AS (SELECT event_id, min_by(detector, o) AS rule, max(score) AS rs, min_by(baseline, o) AS rb FROM a GROUP BY 1),
      f AS (SELECT event_id, max(score) AS ms, min(model) FILTER (score >= 4.0) AS flagged FROM m GROUP BY 1)
      SELECT s.event_id, metric_key, round(value, 6) AS value, rule IS NOT NULL OR flagged IS NOT NULL AS is_anomaly,
        coalesce(rule, flagged, 'none') AS detector, round(greatest(coalesce(rs, 0), coalesce(ms, 0), 0), 6) AS score,
        round(coalesce(rb, value), 6) AS baseline
      FROM samples s LEFT JOIN r USING (event_id) LEFT JOIN f USING (event_id)""",
    "e01_user_column_rule": f"""WITH {SAMPLES_SQL},
      m AS (SELECT *, avg(value) OVER (PARTITION BY metric_key ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS baseline FROM samples),
      x AS (SELECT event_id, 'doubled' AS detector, metric_key, value, baseline, value / (2 * baseline) AS score FROM m WHERE baseline <> 0 AND value / (2 * baseline) >= 1)
      SELECT {_COLS} FROM x""",
    "e02_user_fold_rule": f"""WITH {SAMPLES_SQL},
      d AS (SELECT *, CASE WHEN value > lag(value) OVER w THEN 1 ELSE 0 END AS up FROM samples WINDOW w AS (PARTITION BY metric_key ORDER BY ts, event_id)),
      g AS (SELECT *, sum(1 - up) OVER (PARTITION BY metric_key ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS grp FROM d),
      q AS (SELECT *, sum(up) OVER (PARTITION BY metric_key, grp ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS run,
              lag(value, 3) OVER (PARTITION BY metric_key ORDER BY ts, event_id) AS baseline FROM g),
      x AS (SELECT event_id, 'three-rises' AS detector, metric_key, value, baseline, 3.0 AS score FROM q WHERE run = 3)
      SELECT {_COLS} FROM x""",
}
