"""Registered queries: rolling levels, alert table, retention, late rows, topic records and typed merges."""

from __future__ import annotations

import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions.expressions import from_country
from tidewatch.operators import alerts as A
from tidewatch.operators import rules as R
from tidewatch.operators import slo, traces
from tidewatch.plans import models
from tidewatch.plans.alerts import _ROC, REQUESTS_SQL, requests
from tidewatch.plans.ingest import BASE_SQL, base
from tidewatch.plans.streams import CUTS
from tidewatch.plans.views import COMMON_EVENTS_SQL, common_events, rounded
from tidewatch.session import scratch_path
from tidewatch.sources import dialects as D
from tidewatch.sources import readers, sinks
from tidewatch.streaming import jobs
from tidewatch.streaming.topics import new_records, topic_events


def a25_rolling_levels(spark, sf):
    """Trailing seven days here (thirty in production: the data spans thirty)."""
    return rounded(slo.rolling_service_levels(requests(spark, sf), 7))


def k11_alert_table(spark, sf):
    """Anomalies and fused verdicts appended twice, the first time only half of the anomalies: the table has each once."""
    e = common_events(spark, sf)
    s = R.samples_from_events(e)
    found = R.apply_rules(s, [R.RateOfChange("rate-of-change")])
    models_ = e.where("k % 50 = 0").select("event_id", F.lit("iforest-logs").alias("model"), F.lit(2.0).alias("score"), F.lit(True).alias("is_anomaly"))
    verdicts = R.fuse_scores(s, found.limit(0), models_)
    at = F.lit("2024-03-01").cast("timestamp")
    path = scratch_path(spark, "alerts")
    for batch in (found.where("event_id % 2 = 0"), found, verdicts, found):
        sinks.append_alerts(A.full_alerts(batch, e.select("event_id", "ts", "source", "severity", "k"), at), path)
    out = spark.read.parquet(path)
    return rounded(out.select("id", "detector", "metric_key", "source", "severity", "created_at", "value", "score",
                              F.get_json_object("raw_event", "$.k").cast("bigint").alias("k")))


def k12_moved_partitions(spark, sf):
    """Day partitions of the raw zone older than ten days go to the archive; the second run moves nothing."""
    e = common_events(spark, sf).select("event_id", "source", "ts")
    place = scratch_path(spark, "retention")
    days = sinks.with_hour_partitions(e, F.col("ts")).drop("hour")
    days.repartition("source", "year", "month", "day").write.partitionBy("source", "year", "month", "day").parquet(f"{place}/zone")
    for _ in range(2):
        moved = sinks.move_expired(spark, f"{place}/zone", f"{place}/archive", dt.date(2024, 1, 31), 10)
    again = moved.count()
    rows = [spark.read.parquet(f"{place}/{z}").select("source", F.lit(name).alias("zone"), "ts") for z, name in (("zone", "keep"), ("archive", "archive"))]
    out = rows[0].unionByName(rows[1]).groupBy("source", "zone").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest"))
    return rounded(out.withColumn("moved_again", F.lit(again)))


def d12_late_split(spark, sf):
    """The newest delivery first: all rows of the other two lie behind it and are kept as late."""
    e = common_events(spark, sf).select("event_id", "source", "ts")
    path = scratch_path(spark, "split")
    for i, (a, b) in enumerate(list(zip(CUTS, CUTS[1:]))[::-1]):
        part = e.where((F.col("ts") >= F.lit(a).cast("timestamp")) & (F.col("ts") < F.lit(b).cast("timestamp")))
        part.repartition(4).write.parquet(f"{path}/delivery={i}")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 4).parquet(f"{path}/*").drop("delivery")
    out = scratch_path(spark, "split-out")
    jobs.split_late_stream(stream, f"{out}/on", f"{out}/late", f"{out}/checkpoint", None).awaitTermination()
    kept = [spark.read.parquet(f"{out}/{z}").select("event_id", F.lit(z).alias("zone")) for z in ("on", "late")]
    return kept[0].unionByName(kept[1])


def s05_topic_events(spark, sf):
    """Events as topic records, half of the offsets delivered a second time: each becomes one event."""
    e = base(spark, sf)
    line = F.to_json(F.struct(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("ts"), F.lit("info").alias("level"), F.col("event_type").alias("message"),
                              F.col("event_id").alias("n")))
    value = F.when(F.col("event_id") % 10 == 7, F.lit("{broken")).otherwise(line)
    records = e.select(F.lit(None).cast("binary").alias("key"), value.cast("binary").alias("value"), F.lit("logs.app").alias("topic"),
                       (F.col("event_id") % 6).cast("int").alias("partition"), F.floor(F.col("event_id") / 6).alias("offset"), "ts") \
        .withColumnRenamed("ts", "timestamp")
    src, out = scratch_path(spark, "topic"), scratch_path(spark, "topic-out")
    for part in (records, records.where("offset % 2 = 0")):
        part.repartition(3).write.mode("append").parquet(src)
    q = new_records(readers.stream_topic_files(spark, src, 3)).writeStream.format("parquet").option("path", f"{out}/data")
    q.option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    rows = topic_events(spark.read.parquet(f"{out}/data"))
    return rows.groupBy(F.when(F.col("reason").isNull(), F.col("message")).otherwise(F.lit("bad")).alias("kind")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.get_json_object("attrs", "$.n").cast("bigint")).alias("total"))


def _types(record, keys):
    # a number with a fraction that went through JSON text comes back as a decimal
    kind = lambda v: F.regexp_replace(F.regexp_replace(F.schema_of_variant(v), r"[<(].*", ""), "^DECIMAL$", "DOUBLE")
    return [kind(F.try_element_at(record, F.lit(k))).alias(f"{k}_type") for k in keys]


def i14_typed_attributes(spark, sf):
    """Span attributes as number, boolean, text and list come out as such."""
    attribute = lambda key, kind, value: f"named_struct('key', '{key}', 'value', named_struct('{kind}', {value}))"
    parts = [attribute("count", "intValue", "cast(k AS string)"), attribute("ratio", "doubleValue", "value + 0.5"), attribute("ok", "boolValue", "k % 2 = 0"),
             attribute("kind", "stringValue", "event_type")]
    line = ("concat('{\"traceId\": \"t\", \"spanId\": \"s\", \"name\": \"n\", \"startTimeUnixNano\": \"1704067200000000000\", \"endTimeUnixNano\": \"1704067201000000000\", \"attributes\": [', "
            + ", ',', ".join(f"to_json({p})" for p in parts) + ", ',{\"key\": \"list\", \"value\": {\"arrayValue\": {\"values\": [', k, ', ', k + 1, ']}}}]}')")
    rows = base(spark, sf).select("event_id", F.expr(line).alias("value"))
    ids = F.get_json_object("attrs", "$.attributes")
    out = D.accepted(D.normalize(rows, "otel-traces")).select(F.from_json(ids, "map<string,variant>").alias("m"))
    get = lambda k, kind: F.try_variant_get(F.try_element_at("m", F.lit(k)), "$", kind)
    return rounded(out.groupBy(get("kind", "string").alias("kind"), get("ok", "boolean").alias("ok"), *_types(F.col("m"), ("count", "ratio", "ok", "kind", "list"))).agg(
        F.count(F.lit(1)).alias("n"), F.sum(get("count", "bigint")).alias("count"), F.sum(F.try_variant_get(F.try_element_at("m", F.lit("list")), "$[1]", "bigint")).alias("second")))


def i15_typed_merge(spark, sf):
    """A JSON body merged into its record: types are kept, nested objects of both sides are merged."""
    body = "to_json(named_struct('level', event_type, 'k', k, 'big', k > 10, 'meta', named_struct('user', user_id, 'b', 2)))"
    rec = F.expr(f"to_json(named_struct('stream', 'stdout', 'meta', named_struct('a', event_id, 'b', 1), 'log', CASE WHEN k % 3 = 0 THEN event_type ELSE {body} END))")
    out = base(spark, sf).select("event_id", D.merge_typed_body(rec).alias("r"))
    get = lambda k, path, kind: F.try_variant_get(F.try_element_at("r", F.lit(k)), path, kind)
    return out.select("event_id", get("level", "$", "string").alias("level"), get("k", "$", "bigint").alias("k"), get("big", "$", "boolean").alias("big"),
                      get("meta", "$.a", "bigint").alias("meta_a"), get("meta", "$.b", "bigint").alias("meta_b"), get("meta", "$.user", "bigint").alias("meta_user"),
                      get("log", "$", "string").alias("log"), *_types(F.col("r"), ("k", "big", "meta")))


def m10_sparse_errors(spark, sf):
    """The fixed model of ``m10_fixed_autoencoder`` on sparse spans."""
    sequences, n_services, n_ops = models.sequences_and_sizes(spark, sf)
    dims = n_services + n_ops + 2
    components = np.zeros((dims, 2))
    components[0, 0] = components[dims - 2, 1] = 1.0
    return rounded(traces.sparse_reconstruction_error(traces.sparse_spans(sequences, n_services, n_ops), np.zeros(dims), components))


def p12_event_countries(spark, sf):
    """Web-firewall lines with a country, parsed, then filtered by ``attrs.country``."""
    line = """to_json(named_struct('timestamp', unix_millis(ts), 'webaclId', 'w', 'action', 'BLOCK', 'httpRequest', named_struct('clientIp', '10.0.0.1', 'uri', '/',
        'httpMethod', 'GET', 'country', element_at(array('de', 'FR', 'US', '', NULL), cast(k % 5 as int) + 1), 'headers', array())))"""
    events = D.accepted(D.normalize(base(spark, sf).select(F.expr(line).alias("value")), "waf"))
    picked = events.where(from_country(F.col("attrs"), "DE", "fr"))
    return picked.groupBy(F.get_json_object("attrs", "$.country").alias("country")).agg(F.count(F.lit(1)).alias("n"))


QUERIES = {f.__name__: f for f in (
    a25_rolling_levels, k11_alert_table, k12_moved_partitions, d12_late_split, s05_topic_events, i14_typed_attributes, i15_typed_merge, m10_sparse_errors,
    p12_event_countries)}

_ID = "'al_' || substr(sha256(concat_ws('|', detector, metric_key, CAST(epoch_us(ts) AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 16)"
ORACLES = {
    "a25_rolling_levels": f"""WITH {REQUESTS_SQL}, d AS (SELECT DISTINCT service, CAST(ts AS DATE) AS day FROM req)
      SELECT d.service, d.day, count(*) AS requests, round(count(*) FILTER (status < 300 OR status BETWEEN 400 AND 499) / count(*), 6) AS availability,
        round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms
      FROM d JOIN req r ON r.service = d.service AND CAST(r.ts AS DATE) BETWEEN d.day - 6 AND d.day GROUP BY ALL""",
    "k11_alert_table": f"""WITH {COMMON_EVENTS_SQL}, {_ROC}, a AS (
        SELECT 'rate-of-change' AS detector, metric_key, event_id, ts, value, (value - prev) / abs(prev) * 100 / 200 AS score FROM roc UNION ALL
        SELECT 'iforest-logs', metric_key, event_id, ts, value, 2.0 FROM sm WHERE event_id IN (SELECT event_id FROM common_events WHERE k % 50 = 0))
      SELECT {_ID} AS id, detector, metric_key, e.source, e.severity, TIMESTAMP '2024-03-01' AS created_at, round(a.value, 6) AS value, round(a.score, 6) AS score, e.k
      FROM (SELECT * FROM a) a JOIN (SELECT event_id AS eid, source, severity, k FROM common_events) e ON e.eid = a.event_id""",
    "k12_moved_partitions": f"WITH {COMMON_EVENTS_SQL} SELECT source, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'archive' ELSE 'keep' END AS zone, count(*) AS n, min(ts) AS oldest, CAST(0 AS INT) AS moved_again FROM common_events GROUP BY ALL",
    "d12_late_split": f"WITH {COMMON_EVENTS_SQL} SELECT event_id, CASE WHEN ts >= TIMESTAMP '2024-01-21' THEN 'on' ELSE 'late' END AS zone FROM common_events",
    "s05_topic_events": "SELECT CASE WHEN event_id % 10 = 7 THEN 'bad' ELSE event_type END AS kind, count(*) AS n, CAST(sum(CASE WHEN event_id % 10 <> 7 THEN event_id END) AS BIGINT) AS total FROM events GROUP BY ALL",
    "i14_typed_attributes": f"""WITH {BASE_SQL} SELECT event_type AS kind, k % 2 = 0 AS ok, 'BIGINT' AS count_type, 'DOUBLE' AS ratio_type, 'BOOLEAN' AS ok_type, 'STRING' AS kind_type, 'ARRAY' AS list_type,
      count(*) AS n, CAST(sum(k) AS BIGINT) AS count, CAST(sum(k + 1) AS BIGINT) AS second FROM e GROUP BY ALL""",
    "i15_typed_merge": f"""WITH {BASE_SQL}, x AS (SELECT *, k % 3 <> 0 AS merged FROM e) SELECT event_id, CASE WHEN merged THEN event_type END AS level, CASE WHEN merged THEN k END AS k,
      CASE WHEN merged THEN k > 10 END AS big, event_id AS meta_a, CASE WHEN merged THEN 2 ELSE 1 END::BIGINT AS meta_b, CASE WHEN merged THEN user_id END AS meta_user,
      CASE WHEN NOT merged THEN event_type END AS log, CASE WHEN merged THEN 'BIGINT' END AS k_type, CASE WHEN merged THEN 'BOOLEAN' END AS big_type, 'OBJECT' AS meta_type FROM x""",
    "p12_event_countries": f"WITH {BASE_SQL} SELECT CASE k % 5 WHEN 0 THEN 'de' ELSE 'FR' END AS country, count(*) AS n FROM e WHERE k % 5 < 2 GROUP BY ALL",
    "m10_sparse_errors": models.ORACLES["m10_fixed_autoencoder"],
}
