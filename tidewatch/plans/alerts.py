"""Registered queries: alerts, triage, limits and service levels (Q, J05-J11, A19-A33, T00-T01d, W05-W07, P06-P12, K05-K12, D10-D14, M16)."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.expressions import has_attack_payload, SLOW_REQUEST_MS
from tidewatch.operators import alerts as A
from tidewatch.operators import features as FE
from tidewatch.operators import joins as J
from tidewatch.operators import rules as R
from tidewatch.operators import shop, slo
from tidewatch.operators.drift import summary
from tidewatch.plans.features import DAY, LOG_BASE_SQL
from tidewatch.plans.views import COMMON_EVENTS_SQL, common_events, rounded, table
from tidewatch.schema import LOG_FEATURES
from tidewatch.session import settle


def alerts_table(spark, sf):
    """Alerts raised on failed or large-valued events, with five detectors and some first labels."""
    e = common_events(spark, sf).where("severity IN ('ERROR', 'WARN') OR raw_value > 300")
    return e.select(
        F.expr("concat('al_', event_id)").alias("id"),
        F.expr("CASE k % 5 WHEN 0 THEN 'zscore' WHEN 1 THEN 'ewma' WHEN 2 THEN 'rate-of-change' WHEN 3 THEN 'error-rate-static' ELSE 'iforest-logs' END").alias("detector"),
        F.expr("concat(source, ':', host, ':latency_ms')").alias("metric_key"),
        "source", "host", "severity", F.col("raw_value").alias("value"),
        (F.col("raw_value") / (1 + F.col("k") % 4)).alias("baseline"), (F.col("k") / 20.0).alias("score"),
        F.col("ts").alias("created_at"), F.expr("CASE WHEN k % 3 = 0 THEN 'ignored' END").alias("label"),
        F.expr("concat('value beyond ', cast(k AS string))").alias("explanation"),
    )


ALERTS_SQL = f"""{COMMON_EVENTS_SQL},
alerts AS (SELECT 'al_' || event_id AS id,
    CASE k % 5 WHEN 0 THEN 'zscore' WHEN 1 THEN 'ewma' WHEN 2 THEN 'rate-of-change' WHEN 3 THEN 'error-rate-static' ELSE 'iforest-logs' END AS detector,
    source || ':' || host || ':latency_ms' AS metric_key, source, host, severity, raw_value AS value,
    raw_value / (1 + k % 4) AS baseline, k / 20.0 AS score, ts AS created_at, CASE WHEN k % 3 = 0 THEN 'ignored' END AS label,
    'value beyond ' || k AS explanation
  FROM common_events WHERE severity IN ('ERROR', 'WARN') OR raw_value > 300)"""


def label_log(spark, sf):
    """Two label rounds from the quality table; some labels are not allowed, some ids unknown."""
    l = table(spark, sf, "labels")
    first = l.select(F.expr("concat('al_', doc_id)").alias("alert_id"), F.expr("CASE WHEN doc_id % 17 = 0 THEN 'bogus' ELSE 'ignored' END").alias("label"),
                     F.lit("2024-02-01 00:00:00").cast("timestamp").alias("labelled_at"))
    second = l.where("doc_id % 3 <> 0").select(F.expr("concat('al_', doc_id)").alias("alert_id"),
        F.expr("CASE WHEN doc_id % 19 = 0 THEN 'maybe' WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END").alias("label"),
        F.lit("2024-02-02 00:00:00").cast("timestamp").alias("labelled_at"))
    return first.unionByName(second)


LABELLED_SQL = f"""{ALERTS_SQL},
log AS (SELECT 'al_' || doc_id AS alert_id, CASE WHEN doc_id % 17 = 0 THEN 'bogus' ELSE 'ignored' END AS label, TIMESTAMP '2024-02-01' AS labelled_at FROM labels
  UNION ALL SELECT 'al_' || doc_id, CASE WHEN doc_id % 19 = 0 THEN 'maybe' WHEN quality = 1 THEN 'true_positive' ELSE 'false_positive' END, TIMESTAMP '2024-02-02' FROM labels WHERE doc_id % 3 <> 0),
good AS (SELECT * FROM log WHERE label IN ('true_positive', 'false_positive', 'ignored')),
latest AS (SELECT alert_id, label FROM good QUALIFY row_number() OVER (PARTITION BY alert_id ORDER BY labelled_at DESC, label DESC) = 1),
labelled AS (SELECT a.* REPLACE (coalesce(l.label, a.label) AS label) FROM alerts a LEFT JOIN latest l ON l.alert_id = a.id)"""


def _labelled(spark, sf):
    return A.apply_labels(alerts_table(spark, sf), label_log(spark, sf))


def _events_as(spark, sf, kind):
    return common_events(spark, sf).where(F.col("metric") == kind)


def rendered_paths(spark, sf):
    """Request paths, one in eight carrying an encoded or plain injection payload."""
    return table(spark, sf, "events").select("event_id", F.expr(
        "concat('/api/v1/', event_type, '?q=', CASE event_id % 8 WHEN 0 THEN '%27%20UNION%20SELECT' WHEN 3 THEN '<script>alert(1)</script>' WHEN 5 THEN '%zz' ELSE cast(user_id as string) END)").alias("path"))


def requests(spark, sf):
    """Requests with service, route, status and latency."""
    return common_events(spark, sf).select(
        F.col("source").alias("service"), F.coalesce("path", F.lit("")).alias("route"), "status", F.col("raw_value").alias("latency_ms"), "ts")


REQUESTS_SQL = f"{COMMON_EVENTS_SQL}, req AS (SELECT source AS service, coalesce(path, '') AS route, status, raw_value AS latency_ms, ts FROM common_events)"


def a33_freshness(spark, sf):
    e = common_events(spark, sf)
    e = e.withColumn("ingest_ts", F.expr("ts + make_interval(0, 0, 0, 0, 0, 0, k % 90)"))
    return rounded(slo.freshness(e))


def _shop(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("user_id"), F.col("o_totalprice").alias("total"))
    users = table(spark, sf, "customer").select(F.col("c_custkey").alias("user_id"))
    items = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product_id"), F.col("l_quantity").alias("quantity"))
    products = table(spark, sf, "part").select(
        F.col("p_partkey").alias("product_id"), F.col("p_name").alias("name"), F.col("p_retailprice").alias("price"))
    return orders, users, items, products


def a27_shop_totals(spark, sf):
    orders, users, _, _ = _shop(spark, sf)
    return rounded(shop.totals(orders, users), 2)


def a28_order_totals(spark, sf):
    _, _, items, products = _shop(spark, sf)
    return rounded(shop.order_totals(items, products), 2)


def j10_order_lines(spark, sf):
    orders, _, items, products = _shop(spark, sf)
    return rounded(shop.order_lines(orders, items, products), 2)


def j10_rejected_items(spark, sf):
    """Items of parts that are no longer sold (the large ones)."""
    _, _, items, _ = _shop(spark, sf)
    products = table(spark, sf, "part").where(F.col("p_size") <= 40).select(F.col("p_partkey").alias("product_id"))
    return shop.rejected_items(items, products).groupBy("product_id").agg(F.count(F.lit(1)).alias("n"))


def t01c_product_listing(spark, sf):
    return _shop(spark, sf)[3].orderBy("product_id")


def j08_feature_at_time(spark, sf):
    """Hourly p50 of a series as known at the time of each alert on its host."""
    stats = FE.metric_window_stats(
        common_events(spark, sf).select("ts", "host", "source", F.col("raw_value").alias("value")), ("source", "host"), "1 hour")
    feats = settle(stats.select("source", "host", F.col("window_start").alias("created_at"), "value_p50"))
    left = alerts_table(spark, sf).select("id", "source", "host", "created_at")
    out = J.latest_before(left, feats, ["source", "host"], "created_at", ["value_p50"], piece="day")
    return rounded(out.select("id", "created_at", "value_p50"))


def j09_recent_deployments(spark, sf):
    """Purchases stand for deployments: number and last time on the alert's host in the hour before."""
    left = alerts_table(spark, sf).select("id", "host", F.col("created_at").alias("ts"))
    right = _events_as(spark, sf, "purchase").select("host", "ts")
    return rounded(J.trailing_matches(left, right, ["host"], "ts", 3600, "deployments", "last_deployment").drop("ts"))


def j11_attack_recall(spark, sf):
    """Event kinds stand for injected attacks; detection is the rate-of-change rule."""
    e = common_events(spark, sf)
    attacks = e.where("metric IN ('error', 'signup')").select(
        F.expr("CASE metric WHEN 'error' THEN 'slow-loris' ELSE 'brute-force' END").alias("attack"), "source", "host", "ts")
    s = R.samples_from_events(e)
    hits = R.apply_rules(s, [R.RateOfChange("rate-of-change")]).select("event_id").join(e.select("event_id", "source", "host", "ts"), "event_id")
    return A.attack_recall(hits, attacks, "1 hour")


def w05_rate_limit(spark, sf):
    return A.over_rate_limit(common_events(spark, sf), "user", 2, 43200)


def w05_admitted_requests(spark, sf):
    return A.admitted_requests(common_events(spark, sf), "user", 3, 86400)


def d11_sliding_windows(spark, sf):
    e = common_events(spark, sf)
    out = e.groupBy("source", F.window("ts", "6 hours", "1 hour")["start"].alias("window_start")).agg(F.count(F.lit(1)).alias("n"))
    return rounded(out)


def q08_contributors(spark, sf):
    f = settle(FE.log_window_features(common_events(spark, sf), DAY))
    base = summary(f, LOG_FEATURES)
    return rounded(A.top_contributors(f, base, ["source", "host", "window_start"], LOG_FEATURES).drop("z"))


def k10_online_features(spark, sf):
    """Newest feature record per source and host."""
    f = FE.log_window_counts(common_events(spark, sf), DAY)
    newest = f.groupBy("source", "host").agg(F.max("window_start").alias("feature_timestamp"), F.max_by("request_count", "window_start").alias("request_count"))
    return rounded(newest)


def k11_append_alerts(spark, sf):
    s = R.samples_from_events(common_events(spark, sf))
    a = A.to_alerts(R.apply_rules(s, [R.RateOfChange("rate-of-change")]), F.lit("2024-03-01").cast("timestamp"))
    return rounded(a.select("id", "detector", "metric_key", "created_at", "label"))


def k12_retention(spark, sf):
    """Raw rows older than 10 days go to the archive (90 in production: the data spans 30)."""
    e = common_events(spark, sf).select("event_id", "source", "ts")
    from tidewatch.sources.sinks import retention

    kept = retention(e, "ts", F.lit("2024-01-31").cast("timestamp"), 10)
    return rounded(kept.groupBy("source", "zone").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("oldest")))


def k05_notifications(spark, sf):
    s = R.samples_from_events(common_events(spark, sf))
    return rounded(A.notifications(R.apply_rules(s, [R.RateOfChange("rate-of-change")])).select("event_id", "detector", "value"))


def _listing(**filters):
    return lambda spark, sf: rounded(A.list_alerts(alerts_table(spark, sf), **filters).select("id", "detector", "source", "severity", "created_at"))


QUERIES = {
    "a19_source_health": lambda s, d: rounded(A.source_health(alerts_table(s, d))),
    "a20_alerts_per_key": lambda s, d: A.alerts_per_key(alerts_table(s, d)),
    "a21_failed_logins": lambda s, d: A.failed_logins(common_events(s, d)),
    "a22_detector_precision": lambda s, d: rounded(A.detector_precision(_labelled(s, d))),
    "a23_anomaly_rate": lambda s, d: rounded(A.anomaly_rate(common_events(s, d), alerts_table(s, d))),
    "a24_requests_by_status": lambda s, d: slo.requests_by_status(requests(s, d)),
    "a24_latency_histogram": lambda s, d: slo.latency_histogram(requests(s, d)),
    "a25_service_levels": lambda s, d: rounded(slo.service_levels(requests(s, d))),
    "a26_error_budget_burn": lambda s, d: rounded(slo.error_budget_burn(requests(s, d))),
    "a27_shop_totals": a27_shop_totals,
    "a28_order_totals": a28_order_totals,
    "a31_brute_force_windows": lambda s, d: rounded(A.brute_force_windows(common_events(s, d), "1 day", 60, 20, 60)),
    "a33_freshness": a33_freshness,
    "d10_tumbling_windows": lambda s, d: rounded(common_events(s, d).groupBy("source", F.window("ts", "1 minute")["start"].alias("minute")).agg(F.count(F.lit(1)).alias("n"))),
    "d11_sliding_windows": d11_sliding_windows,
    "d14_platform_events": lambda s, d: rounded(A.platform_events(alerts_table(s, d), "1 day", 12)),
    "j05_similar_alerts": lambda s, d: A.explain(alerts_table(s, d)).select("id", F.array_join("similar", ",").alias("similar")),
    "j06_labelled_alerts": lambda s, d: _labelled(s, d).select("id", "label"),
    "j06_unknown_labels": lambda s, d: rounded(A.unknown_labels(alerts_table(s, d), label_log(s, d))),
    "j08_feature_at_time": j08_feature_at_time,
    "j09_recent_deployments": j09_recent_deployments,
    "j10_order_lines": j10_order_lines,
    "j10_rejected_items": j10_rejected_items,
    "j11_attack_recall": j11_attack_recall,
    "k05_notifications": k05_notifications,
    "k10_online_features": k10_online_features,
    "k11_append_alerts": k11_append_alerts,
    "k12_retention": k12_retention,
    "m16_precision_pause": lambda s, d: rounded(slo.precision_pause(_labelled(s, d), days=3)),
    "p06_alert_filters": _listing(since="2024-01-15", source="app", severity="ERROR", limit=1000),
    "p07_alert_by_id": lambda s, d: rounded(A.alert_by_id(alerts_table(s, d), "al_0")),
    "p10_attack_payloads": lambda s, d: rendered_paths(s, d).where(has_attack_payload(F.col("path"))),
    "p11_slow_requests": lambda s, d: rounded(common_events(s, d).withColumn("latency_ms", F.col("raw_value") * 100).where(F.col("latency_ms") >= SLOW_REQUEST_MS).select("event_id", "latency_ms")),
    "p12_country_filter": lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).where(F.col("n_name").isin("NATION_3", "FRANCE", "CHINA")).select("c_custkey", "n_name"),
    "q01_list_alerts": _listing(severity="WARN"),
    "q02_explain_alerts": lambda s, d: rounded(A.explain(alerts_table(s, d)).select("id", "metric_key", "value", "baseline", "delta", "score", "explanation", F.size("similar").alias("n_similar"))),
    "q03_feedback_labels": lambda s, d: A.valid_labels(label_log(s, d)).groupBy("label").agg(F.count(F.lit(1)).alias("n")),
    "q04_source_health": lambda s, d: rounded(A.source_health(alerts_table(s, d))),
    "q05_storm_keys": lambda s, d: A.top_keys(A.list_alerts(alerts_table(s, d), limit=500)),
    "q06_target_breadth": lambda s, d: A.target_breadth(common_events(s, d), few=1),
    "q07_detector_review": lambda s, d: rounded(A.detector_precision(_labelled(s, d)).withColumn("needs_tuning", F.col("precision") < 0.7).drop("true_positives")),
    "q08_contributors": q08_contributors,
    "t00_newest_alerts": _listing(),
    "t01a_top_keys": lambda s, d: A.top_keys(alerts_table(s, d)),
    "t01c_product_listing": t01c_product_listing,
    "t01d_loudest_false_positives": lambda s, d: A.loudest_false_positives(_labelled(s, d)),
    "w04_latest_label": lambda s, d: A.valid_labels(label_log(s, d)).groupBy("alert_id").agg(F.max_by("label", F.struct("labelled_at", "label")).alias("label")),
    "w05_rate_limit": w05_rate_limit,
    "w05_admitted_requests": w05_admitted_requests,
    "w07_without_repeats": lambda s, d: A.without_repeats(alerts_table(s, d), 120).select("id"),
    "w07_cooldown": lambda s, d: A.with_cooldown(alerts_table(s, d), 1440),
}

_PAGE = "ORDER BY created_at DESC, id DESC LIMIT"
_LIST = "id, detector, source, severity, created_at"
_SHOP_SQL = """o AS (SELECT o_orderkey AS order_id, o_custkey AS user_id, o_totalprice AS total FROM orders),
i AS (SELECT l_orderkey AS order_id, l_partkey AS product_id, l_quantity AS quantity FROM lineitem),
p AS (SELECT p_partkey AS product_id, p_name AS name, p_retailprice AS price FROM part)"""
_EDGES = ", ".join(f"('{e}', {e})" for e in slo.LATENCY_EDGES)
_SIM = f"""{ALERTS_SQL}, rec AS (SELECT id, metric_key, created_at FROM alerts {_PAGE} 200),
sim AS (SELECT a.id, r.id AS rid, r.created_at, row_number() OVER (PARTITION BY a.id ORDER BY r.created_at DESC, r.id DESC) AS rn FROM alerts a JOIN rec r ON r.metric_key = a.metric_key AND r.id <> a.id),
five AS (SELECT id, string_agg(rid, ',' ORDER BY rn) AS "similar", count(*) AS n FROM sim WHERE rn <= 5 GROUP BY id)"""
_F_LONG = " UNION ALL ".join(f"SELECT source, host, window_start, '{f}' AS feature, {f} AS v FROM feats" for f in LOG_FEATURES)
_ROC = """sm AS (SELECT event_id, ts, source, host,
   CASE WHEN source = 'node-metrics' THEN concat_ws(':', source, host, metric) WHEN latency_ms IS NOT NULL THEN concat_ws(':', source, host, 'latency_ms')
        ELSE concat_ws(':', source, host, 'status_' || (status // 100) || 'xx') END AS metric_key,
   CASE WHEN source = 'node-metrics' THEN metric_value WHEN latency_ms IS NOT NULL THEN latency_ms ELSE 1.0 END AS value FROM common_events),
 lg AS (SELECT *, lag(value) OVER (PARTITION BY metric_key ORDER BY ts, event_id) AS prev FROM sm),
 roc AS (SELECT * FROM lg WHERE prev <> 0 AND (value - prev) / abs(prev) * 100 >= 200)"""

ORACLES = {
    "a19_source_health": f'WITH {ALERTS_SQL} SELECT source, max(created_at) AS last_seen, count(*) AS "count" FROM alerts GROUP BY source',
    "a20_alerts_per_key": f"WITH {ALERTS_SQL} SELECT metric_key, count(*) AS n FROM alerts GROUP BY metric_key",
    "a21_failed_logins": f"WITH {COMMON_EVENTS_SQL} SELECT src_ip, \"user\", count(*) AS n FROM common_events WHERE source = 'app' AND status = 401 AND contains(path, 'login') GROUP BY ALL",
    "a22_detector_precision": f"WITH {LABELLED_SQL}, c AS (SELECT detector, count(*) AS total, count(*) FILTER (label = 'true_positive') AS true_positives, count(*) FILTER (label = 'false_positive') AS false_positives FROM labelled GROUP BY detector) SELECT *, round(CASE WHEN true_positives + false_positives > 0 THEN true_positives / (true_positives + false_positives) END, 6) AS \"precision\" FROM c",
    "a23_anomaly_rate": f"WITH {ALERTS_SQL} SELECT e.source, events, coalesce(anomalies, 0) AS anomalies, round(coalesce(anomalies, 0) / events, 6) AS rate FROM (SELECT source, count(*) AS events FROM common_events GROUP BY 1) e LEFT JOIN (SELECT source, count(*) AS anomalies FROM alerts GROUP BY 1) a ON a.source = e.source",
    "a24_requests_by_status": f"WITH {REQUESTS_SQL} SELECT route, status, count(*) AS n FROM req GROUP BY ALL",
    "a24_latency_histogram": f"WITH {REQUESTS_SQL} SELECT route, le, count(*) FILTER (latency_ms / 1000 <= e) AS n FROM req CROSS JOIN (VALUES {_EDGES}, ('+Inf', 1e300)) v(le, e) GROUP BY route, le",
    "a25_service_levels": f"WITH {REQUESTS_SQL} SELECT service, count(*) AS requests, round(count(*) FILTER (status < 300 OR status BETWEEN 400 AND 499) / count(*), 6) AS availability, round(count(*) FILTER (status >= 500) / count(*), 6) AS error_rate, round(quantile_cont(latency_ms, 0.99), 6) AS p99_latency_ms FROM req GROUP BY service",
    "a26_error_budget_burn": f"""WITH {REQUESTS_SQL},
      per AS (SELECT service, (epoch_us(ts) // 60000000) * 60 AS second, count(*) AS n, count(*) FILTER (status >= 500) AS bad FROM req GROUP BY ALL),
      h AS (SELECT service, second, 3600 AS horizon_seconds, sum(bad) OVER w / sum(n) OVER w AS er, 0.02 AS share, 'page' AS action FROM per WINDOW w AS (PARTITION BY service ORDER BY second RANGE BETWEEN 3540 PRECEDING AND CURRENT ROW)
       UNION ALL SELECT service, second, 21600, sum(bad) OVER w / sum(n) OVER w, 0.05, 'page' FROM per WINDOW w AS (PARTITION BY service ORDER BY second RANGE BETWEEN 21540 PRECEDING AND CURRENT ROW)
       UNION ALL SELECT service, second, 259200, sum(bad) OVER w / sum(n) OVER w, 0.10, 'ticket' FROM per WINDOW w AS (PARTITION BY service ORDER BY second RANGE BETWEEN 259140 PRECEDING AND CURRENT ROW))
      SELECT service, second, horizon_seconds, round(er / 0.005 * (CAST(horizon_seconds AS DOUBLE) / 2592000), 6) + 0.0 AS burned, action, er / 0.005 * (CAST(horizon_seconds AS DOUBLE) / 2592000) >= share AS breach FROM h""",
    "a27_shop_totals": f"SELECT count(*) AS orders, round(coalesce(sum(o_totalprice), 0), 2) AS revenue, (SELECT count(*) FROM customer) AS users FROM orders",
    "a28_order_totals": f"WITH {_SHOP_SQL} SELECT order_id, round(sum(price * quantity), 2) AS total, count(*) AS lines FROM i JOIN p USING (product_id) GROUP BY order_id",
    "a31_brute_force_windows": f"WITH {COMMON_EVENTS_SQL} SELECT time_bucket(INTERVAL '1 day', ts) AS window_start, count(*) AS failures, count(DISTINCT \"user\") AS users, count(DISTINCT src_ip) AS ips FROM common_events WHERE status = 401 GROUP BY 1 HAVING count(*) >= 60 AND count(DISTINCT \"user\") >= 20 AND count(DISTINCT src_ip) <= 60",
    "a33_freshness": f"WITH {COMMON_EVENTS_SQL} SELECT source, time_bucket(INTERVAL '1 minute', ts + to_seconds(k % 90)) AS minute, CAST(max(k % 90) AS DOUBLE) AS max_lag_s FROM common_events GROUP BY ALL",
    "d10_tumbling_windows": f"WITH {COMMON_EVENTS_SQL} SELECT source, time_bucket(INTERVAL '1 minute', ts) AS minute, count(*) AS n FROM common_events GROUP BY ALL",
    "d11_sliding_windows": f"WITH {COMMON_EVENTS_SQL} SELECT source, time_bucket(INTERVAL '1 hour', ts) - to_hours(h) AS window_start, count(*) AS n FROM common_events CROSS JOIN range(0, 6) t(h) GROUP BY ALL",
    "d14_platform_events": f"WITH {ALERTS_SQL} SELECT time_bucket(INTERVAL '1 day', created_at) AS window_start, detector, split_part(metric_key, ':', 3) AS signal, count(DISTINCT split_part(metric_key, ':', 1) || ':' || split_part(metric_key, ':', 2)) AS hosts FROM alerts GROUP BY 1, 2, 3 HAVING count(DISTINCT split_part(metric_key, ':', 1) || ':' || split_part(metric_key, ':', 2)) >= 12",
    "j05_similar_alerts": f"WITH {_SIM} SELECT a.id, coalesce(\"similar\", '') AS \"similar\" FROM alerts a LEFT JOIN five USING (id)",
    "j06_labelled_alerts": f"WITH {LABELLED_SQL} SELECT id, label FROM labelled",
    "j06_unknown_labels": f"WITH {LABELLED_SQL} SELECT * FROM log WHERE alert_id NOT IN (SELECT id FROM alerts)",
    "j08_feature_at_time": f"""WITH {ALERTS_SQL}, f AS (SELECT source, host, time_bucket(INTERVAL '1 hour', ts) AS t, quantile_cont(raw_value, 0.5) AS value_p50 FROM common_events GROUP BY ALL)
      SELECT a.id, a.created_at, round(f.value_p50, 6) AS value_p50 FROM alerts a ASOF LEFT JOIN f ON a.source = f.source AND a.host = f.host AND a.created_at >= f.t""",
    "j09_recent_deployments": f"WITH {ALERTS_SQL}, d AS (SELECT host, ts FROM common_events WHERE metric = 'purchase') SELECT a.id, a.host, count(d.ts) AS deployments, max(d.ts) AS last_deployment FROM alerts a LEFT JOIN d ON d.host = a.host AND d.ts BETWEEN a.created_at - INTERVAL 60 MINUTE AND a.created_at GROUP BY a.id, a.host",
    "j10_order_lines": f"WITH {_SHOP_SQL} SELECT product_id, order_id, user_id, total, quantity, name, price FROM o JOIN i USING (order_id) JOIN p USING (product_id)",
    "j10_rejected_items": f"WITH {_SHOP_SQL} SELECT product_id, count(*) AS n FROM i WHERE product_id NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40) GROUP BY product_id",
    "j11_attack_recall": f"""WITH {COMMON_EVENTS_SQL}, {_ROC},
      a AS (SELECT DISTINCT CASE metric WHEN 'error' THEN 'slow-loris' ELSE 'brute-force' END AS attack, source, host, time_bucket(INTERVAL '1 hour', ts) AS w FROM common_events WHERE metric IN ('error', 'signup')),
      h AS (SELECT DISTINCT source, host, time_bucket(INTERVAL '1 hour', ts) AS w FROM roc)
      SELECT attack, count(*) AS windows, count(h.w) AS detected FROM a LEFT JOIN h USING (source, host, w) GROUP BY attack""",
    "k05_notifications": f"WITH {COMMON_EVENTS_SQL}, {_ROC} SELECT event_id, 'rate-of-change' AS detector, round(value, 6) AS value FROM roc ORDER BY ts, event_id LIMIT 10",
    "k10_online_features": f"{LOG_BASE_SQL} SELECT source, host, window_start AS feature_timestamp, request_count FROM feats QUALIFY row_number() OVER (PARTITION BY source, host ORDER BY window_start DESC) = 1",
    "k11_append_alerts": f"WITH {COMMON_EVENTS_SQL}, {_ROC} SELECT 'al_' || substr(sha256(concat_ws('|', 'rate-of-change', metric_key, CAST(epoch_us(ts) AS VARCHAR), CAST(event_id AS VARCHAR))), 1, 16) AS id, 'rate-of-change' AS detector, metric_key, TIMESTAMP '2024-03-01' AS created_at, CAST(NULL AS VARCHAR) AS label FROM roc",
    "k12_retention": f"WITH {COMMON_EVENTS_SQL} SELECT source, CASE WHEN ts < TIMESTAMP '2024-01-21' THEN 'archive' ELSE 'keep' END AS zone, count(*) AS n, min(ts) AS oldest FROM common_events GROUP BY ALL",
    "m16_precision_pause": f"""WITH {LABELLED_SQL}, d AS (SELECT detector, date_trunc('day', created_at) AS day, count(*) FILTER (label = 'true_positive') AS tp, count(*) FILTER (label = 'false_positive') AS fp FROM labelled GROUP BY ALL),
      p AS (SELECT detector, CAST(day AS TIMESTAMP) AS day, tp / (tp + fp) AS pr FROM d WHERE tp + fp > 0)
      SELECT detector, day, round(pr, 6) AS "precision", round(min(pr) OVER w, 6) AS week_min, max(pr) OVER w < 0.9 AND count(*) OVER w >= 3 AS pause FROM p WINDOW w AS (PARTITION BY detector ORDER BY day RANGE BETWEEN INTERVAL 2 DAYS PRECEDING AND CURRENT ROW)""",
    "p06_alert_filters": f"WITH {ALERTS_SQL} SELECT {_LIST} FROM alerts WHERE created_at >= TIMESTAMP '2024-01-15' AND source = 'app' AND severity = 'ERROR' {_PAGE} 1000",
    "p07_alert_by_id": f"WITH {ALERTS_SQL} SELECT * REPLACE (round(baseline, 6) AS baseline) FROM alerts WHERE id = 'al_0'",
    "p10_attack_payloads": "SELECT event_id, '/api/v1/' || event_type || '?q=' || CASE event_id % 8 WHEN 0 THEN '%27%20UNION%20SELECT' ELSE '<script>alert(1)</script>' END AS path FROM events WHERE event_id % 8 IN (0, 3)",
    "p11_slow_requests": "SELECT event_id, round(value * 100, 6) AS latency_ms FROM events WHERE value * 100 >= 30000",
    "p12_country_filter": "SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_name IN ('NATION_3', 'FRANCE', 'CHINA')",
    "q01_list_alerts": f"WITH {ALERTS_SQL} SELECT {_LIST} FROM alerts WHERE severity = 'WARN' {_PAGE} 100",
    "q02_explain_alerts": f"WITH {_SIM} SELECT a.id, metric_key, value, round(baseline, 6) AS baseline, round(value - baseline, 6) + 0.0 AS delta, score, explanation, CAST(coalesce(n, 0) AS INT) AS n_similar FROM alerts a LEFT JOIN five USING (id)",
    "q03_feedback_labels": f"WITH {LABELLED_SQL} SELECT label, count(*) AS n FROM good GROUP BY label",
    "q04_source_health": f"WITH {ALERTS_SQL} SELECT source, max(created_at) AS last_seen, count(*) AS \"count\" FROM alerts GROUP BY source",
    "q05_storm_keys": f"WITH {ALERTS_SQL}, r AS (SELECT metric_key FROM alerts {_PAGE} 500) SELECT metric_key, count(*) AS n FROM r GROUP BY 1 ORDER BY n DESC, metric_key LIMIT 10",
    "q06_target_breadth": f"WITH {COMMON_EVENTS_SQL} SELECT src_ip, count(*) AS failures, count(DISTINCT \"user\") AS users, CASE WHEN count(DISTINCT \"user\") <= 1 THEN 'account-takeover' ELSE 'stuffing' END AS shape FROM common_events WHERE source = 'app' AND status = 401 AND contains(path, 'login') GROUP BY src_ip",
    "q07_detector_review": f"WITH {LABELLED_SQL}, c AS (SELECT detector, count(*) AS total, count(*) FILTER (label = 'true_positive') AS tp, count(*) FILTER (label = 'false_positive') AS false_positives FROM labelled GROUP BY detector) SELECT detector, total, false_positives, round(tp / (tp + false_positives), 6) AS \"precision\", tp / (tp + false_positives) < 0.7 AS needs_tuning FROM c",
    "q08_contributors": f"""{LOG_BASE_SQL}, lng AS ({_F_LONG}), b AS (SELECT feature, avg(v) AS mean, stddev_pop(v) AS sd FROM lng GROUP BY feature),
      z AS (SELECT source, host, window_start, feature, v AS observed, mean AS baseline, (v - mean) / CASE WHEN sd = 0 THEN 1e-9 ELSE sd END AS z FROM lng JOIN b USING (feature)),
      r AS (SELECT *, row_number() OVER (PARTITION BY source, host, window_start ORDER BY -abs(z), feature) AS rank FROM z)
      SELECT source, host, window_start, CAST(rank AS INT) AS rank, feature, round(observed, 6) AS observed, round(baseline, 6) AS baseline FROM r WHERE rank <= 3""",
    "t00_newest_alerts": f"WITH {ALERTS_SQL} SELECT {_LIST} FROM alerts {_PAGE} 100",
    "t01a_top_keys": f"WITH {ALERTS_SQL} SELECT metric_key, count(*) AS n FROM alerts GROUP BY 1 ORDER BY n DESC, metric_key LIMIT 10",
    "t01c_product_listing": f"WITH {_SHOP_SQL} SELECT * FROM p ORDER BY product_id",
    "t01d_loudest_false_positives": f"WITH {LABELLED_SQL}, c AS (SELECT detector, metric_key, count(*) AS n FROM labelled WHERE label = 'false_positive' GROUP BY ALL) SELECT detector, metric_key, n FROM c QUALIFY row_number() OVER (PARTITION BY detector ORDER BY n DESC, metric_key DESC) = 1",
    "w04_latest_label": f"WITH {LABELLED_SQL} SELECT * FROM latest",
    "w05_admitted_requests": f"""WITH RECURSIVE {COMMON_EVENTS_SQL}, per AS (
      SELECT *, row_number() OVER (PARTITION BY "user" ORDER BY second) AS i FROM (
        SELECT "user", epoch_us(ts) // 1000000 AS second, count(*) AS requests FROM common_events WHERE "user" IS NOT NULL GROUP BY ALL)),
      walk AS (
        SELECT "user", second, requests, i, least(requests, 3) AS admitted, [{{'s': second, 'a': least(requests, 3)}}] AS past FROM per WHERE i = 1
        UNION ALL
        SELECT "user", second, requests, i, admitted, list_append(past, {{'s': second, 'a': admitted}}) FROM (
          SELECT p."user", p.second, p.requests, p.i, past, least(p.requests, 3 - coalesce(list_sum([x.a for x in past if p.second - x.s <= 86400]), 0)) AS admitted
          FROM walk w JOIN per p ON p."user" = w."user" AND p.i = w.i + 1))
      SELECT "user", second, requests, CAST(admitted AS BIGINT) AS admitted FROM walk""",
    "w05_rate_limit": f"""WITH {COMMON_EVENTS_SQL}, per AS (SELECT "user", epoch_us(ts) // 1000000 AS second, count(*) AS requests FROM common_events GROUP BY ALL),
      t AS (SELECT *, CAST(sum(requests) OVER (PARTITION BY "user" ORDER BY second RANGE BETWEEN 43200 PRECEDING AND CURRENT ROW) AS BIGINT) AS "trailing" FROM per) SELECT * FROM t WHERE "trailing" > 2""",
    "w07_without_repeats": f"WITH {ALERTS_SQL}, g AS (SELECT id, created_at - lag(created_at) OVER (PARTITION BY metric_key ORDER BY created_at, id) AS gap FROM alerts) SELECT id FROM g WHERE gap IS NULL OR gap > INTERVAL 120 MINUTE",
    "w07_cooldown": f"""WITH RECURSIVE {ALERTS_SQL}, s AS (SELECT metric_key, epoch_us(created_at) // 1000000 AS second, min(id) AS id FROM alerts GROUP BY ALL),
      e AS (SELECT metric_key, min(second) AS second FROM s GROUP BY metric_key
        UNION ALL SELECT e.metric_key, min(s.second) FROM e JOIN s ON s.metric_key = e.metric_key AND s.second > e.second + 86400 GROUP BY e.metric_key)
      SELECT s.metric_key, s.second, s.id FROM s JOIN e USING (metric_key, second)""",
}
