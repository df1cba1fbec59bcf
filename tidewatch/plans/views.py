"""The observability tables as views over the relational test tables.

The test data holds no log files, so each view derives one table of the event
model from a whole given table.  Every view has a SQL twin for the checks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _k(props: str = "props") -> Column:
    return F.get_json_object(props, "$.k").cast("bigint")


def common_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Common events: four sources by user, with latency, status-only and metric rows."""
    e = table(spark, sf_dir, "events").withColumn("k", _k())
    return e.select(
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        F.expr("CASE user_id % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'nginx' WHEN 2 THEN 'alb' ELSE 'node-metrics' END").alias("source"),
        F.expr("concat('node-', user_id % 10)").alias("host"),
        F.expr("CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END").alias("severity"),
        F.expr("CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 401 ELSE 200 END").alias("status"),
        F.expr("CASE WHEN user_id % 4 IN (0, 2) THEN value END").alias("latency_ms"),
        F.expr("CASE WHEN user_id % 4 <> 3 THEN k END").alias("bytes"),
        F.expr("CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN '' ELSE concat('10.0.0.', user_id % 250) END").alias("src_ip"),
        F.expr("concat('user-', user_id)").alias("user"),
        F.expr("CASE WHEN k % 13 = 0 THEN NULL WHEN event_type = 'signup' THEN '/api/v1/login' ELSE concat('/api/v1/', event_type) END").alias("path"),
        F.expr("CASE WHEN k % 7 = 0 THEN NULL ELSE concat('ua-', k % 5) END").alias("user_agent"),
        F.concat_ws(" ", "event_type", F.lit("by user"), "user_id").alias("message"),
        F.col("event_type").alias("metric"),
        F.expr("CASE WHEN user_id % 4 = 3 THEN value END").alias("metric_value"),
        F.col("value").alias("raw_value"),
        "k",
    )


COMMON_EVENTS_SQL = """
common_events AS (
  SELECT event_id, ts,
    CASE user_id % 4 WHEN 0 THEN 'app' WHEN 1 THEN 'nginx' WHEN 2 THEN 'alb' ELSE 'node-metrics' END AS source,
    'node-' || (user_id % 10) AS host,
    CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARN' ELSE 'INFO' END AS severity,
    CASE event_type WHEN 'error' THEN 500 WHEN 'signup' THEN 401 ELSE 200 END AS status,
    CASE WHEN user_id % 4 IN (0, 2) THEN value END AS latency_ms,
    CASE WHEN user_id % 4 <> 3 THEN k END AS bytes,
    CASE WHEN k % 11 = 0 THEN NULL WHEN k % 11 = 1 THEN '' ELSE '10.0.0.' || (user_id % 250) END AS src_ip,
    'user-' || user_id AS "user",
    CASE WHEN k % 13 = 0 THEN NULL WHEN event_type = 'signup' THEN '/api/v1/login' ELSE '/api/v1/' || event_type END AS path,
    CASE WHEN k % 7 = 0 THEN NULL ELSE 'ua-' || (k % 5) END AS user_agent,
    event_type || ' by user ' || user_id AS message,
    event_type AS metric,
    CASE WHEN user_id % 4 = 3 THEN value END AS metric_value,
    value AS raw_value, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)
)"""


def naive(name: str, alias: str | None = None) -> Column:
    """A timestamp without zone, so that every engine prints the same value."""
    return F.col(name).cast("timestamp_ntz").alias(alias or name)


def r6(name: str, alias: str | None = None) -> Column:
    return F.round(F.col(name), 6).alias(alias or name)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Comparable form: doubles rounded, -0.0 turned into 0.0, zoned times made naive."""
    cols = []
    for f in df.schema.fields:
        kind = f.dataType.simpleString()
        c = F.col(f"`{f.name}`")
        if kind == "double":
            # rounding goes through decimal text; a whole number is rounded already
            c = F.when(c == F.rint(c), c).otherwise(F.round(c, digits)) + F.lit(0.0)
        elif kind == "timestamp":
            c = c.cast("timestamp_ntz")
        cols.append(c.alias(f.name))
    return df.select(*cols)
