"""Registered queries: streaming jobs run to completion over the whole event table."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import rules as R
from tidewatch.plans.ingest import BASE_SQL, raw_lines
from tidewatch.plans.rules import ALL_RULES_SQL, SAMPLES_SQL
from tidewatch.plans.views import COMMON_EVENTS_SQL, common_events, rounded
from tidewatch.session import scratch_path
from tidewatch.sources import readers
from tidewatch.streaming import jobs
from tidewatch.streaming.rules_stream import stream_rules

# Bounds of the three deliveries the event table is staged in.
CUTS = ("2024-01-01", "2024-01-11", "2024-01-21", "2100-01-01")


def staged(spark, df, name, files):
    """The events as three deliveries in time order; one micro-batch reads one delivery."""
    path = scratch_path(spark, name)
    for i, (a, b) in enumerate(zip(CUTS, CUTS[1:])):
        part = df.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
        part.repartition(files).write.parquet(f"{path}/delivery={i}")
    return path


def _stream(spark, df, path, files):
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*").drop("delivery")


def d08_score_stream(spark, sf):
    e = common_events(spark, sf)
    path = staged(spark, e, "score", 4)
    out = scratch_path(spark, "score-out")
    q = jobs.score_stream(_stream(spark, e, path, 4), f"{out}/anomalies", f"{out}/notify", f"{out}/checkpoint", R.default_rules(), None)
    q.awaitTermination()
    a = spark.read.json(f"{out}/anomalies")
    return rounded(a.select("event_id", "detector", "metric_key", F.col("value").cast("double").alias("value"),
                            F.col("baseline").cast("double").alias("baseline"), F.col("score").cast("double").alias("score")))


def d12_late_rows(spark, sf):
    """The newest delivery first: the oldest one lies behind the watermark and stays out.

    Late rows are judged by the watermark of the batch before, so the middle
    delivery still passes.
    """
    e = R.samples_from_events(common_events(spark, sf))
    path = scratch_path(spark, "late")
    for i, (a, b) in enumerate(list(zip(CUTS, CUTS[1:]))[::-1]):
        part = e.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
        part.repartition(4).write.parquet(f"{path}/delivery={i}")
    out = scratch_path(spark, "late-out")
    found = stream_rules(_stream(spark, e, path, 4), [R.StaticThreshold("error-rate-static")])
    q = found.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
    q.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return spark.read.parquet(f"{out}/data").select("event_id", "detector")


def d10_window_stream(spark, sf):
    e = common_events(spark, sf)
    path = staged(spark, e, "windows", 4)
    out = scratch_path(spark, "windows-out")
    w = jobs.windowed_counts(_stream(spark, e, path, 4), "1 hour")
    q = w.writeStream.format("parquet").option("path", f"{out}/data").option("checkpointLocation", f"{out}/checkpoint")
    q.trigger(availableNow=True).outputMode("append").start().awaitTermination()
    return rounded(spark.read.parquet(f"{out}/data").select("source", "window_start", "n", "errors"))


def d13_ingest_stream(spark, sf):
    """Access-log lines as a stream: over-long and broken lines go to the error zone."""
    src = scratch_path(spark, "lines")
    lines = raw_lines(spark, sf, "nginx")
    # Every line that ends in ua4 gets an over-long tail.
    lines = lines.select(F.when(F.col("value").endswith('"ua4"'), F.concat("value", F.repeat(F.lit("x"), 400))).otherwise(F.col("value")).alias("value"))
    lines.repartition(4).write.text(src)
    out = scratch_path(spark, "ingest-out")
    stream = readers.stream_lines(spark, src, files_per_trigger=2)
    # Day folders: hour folders would hold a handful of rows each.
    by = ("year", "month", "day")
    jobs.ingest_stream(stream, "nginx", f"{out}/raw", f"{out}/errors", f"{out}/checkpoint", None, by, max_chars=300).awaitTermination()
    good = readers.read_raw_zone(spark, f"{out}/raw").groupBy(F.lit("event").alias("outcome"), "severity").agg(F.count(F.lit(1)).alias("n"))
    bad = spark.read.json(f"{out}/errors").groupBy(F.col("reason").alias("outcome"), F.lit(None).cast("string").alias("severity")).agg(F.count(F.lit(1)).alias("n"))
    return good.unionByName(bad)


QUERIES = {"d08_score_stream": d08_score_stream, "d10_window_stream": d10_window_stream, "d12_late_rows": d12_late_rows, "d13_ingest_stream": d13_ingest_stream}

ORACLES = {
    "d08_score_stream": f"WITH RECURSIVE {ALL_RULES_SQL} SELECT event_id, detector, metric_key, round(value, 6) AS value, round(baseline, 6) AS baseline, round(score, 6) AS score FROM anomalies",
    "d10_window_stream": f"""WITH {COMMON_EVENTS_SQL} SELECT source, time_bucket(INTERVAL '1 hour', ts) AS window_start, count(*) AS n, count(*) FILTER (status >= 500) AS errors
      FROM common_events GROUP BY ALL HAVING time_bucket(INTERVAL '1 hour', any_value(ts)) + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM common_events)""",
    "d12_late_rows": f"WITH {SAMPLES_SQL} SELECT event_id, 'error-rate-static' AS detector FROM samples WHERE ts >= TIMESTAMP '2024-01-11' AND value > 0.05",
    "d13_ingest_stream": f"""WITH {BASE_SQL}, r AS (SELECT CASE WHEN event_id % 10 = 7 THEN 'no_match' WHEN k % 5 = 4 THEN 'too_long' ELSE 'event' END AS outcome,
        CASE WHEN event_id % 10 <> 7 AND k % 5 <> 4 THEN CASE WHEN status >= 500 THEN 'ERROR' WHEN status >= 400 THEN 'WARN' END END AS severity, event_id, k FROM e)
      SELECT outcome, severity, count(*) AS n FROM r GROUP BY ALL""",
}
