"""Registered queries: validation, baselines and drift."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions.expressions import has_error_word, value_has_pii
from tidewatch.operators import drift as D
from tidewatch.operators import validation as V
from tidewatch.plans.views import COMMON_EVENTS_SQL, common_events, rounded, table

FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
SPLIT = "1998-01-01"


def reference_rows(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.where(F.col("l_shipdate") < F.lit(SPLIT).cast("timestamp_ntz")).select(*FEATURES)


def current_rows(spark, sf, *keep):
    """Later lines: dearer, heavier discounts, with gaps in the quantity."""
    li = table(spark, sf, "lineitem").where(F.col("l_shipdate") >= F.lit(SPLIT).cast("timestamp_ntz"))
    return li.select(
        *keep,
        F.when(F.col("l_linenumber") % 7 != 0, F.col("l_quantity")).alias("l_quantity"),
        (F.col("l_extendedprice") * 1.25).alias("l_extendedprice"),
        (F.col("l_discount") / 2).alias("l_discount"),
        "l_tax",
        F.col("l_linenumber").cast("double").alias("new_feature"),
    )


REF_SQL = "ref AS (SELECT l_quantity, l_extendedprice, l_discount, l_tax FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')"
CUR_SQL = """cur AS (SELECT CASE WHEN l_linenumber % 7 <> 0 THEN l_quantity END AS l_quantity,
  l_extendedprice * CAST(1.25 AS DOUBLE) AS l_extendedprice, l_discount / 2 AS l_discount, l_tax, year(l_shipdate) AS ship_year
  FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"""


def _long(name, src, extra=""):
    parts = [f"SELECT {extra} '{f}' AS feature, {f} AS v FROM {src}" for f in FEATURES]
    return f"{name} AS ({' UNION ALL '.join(parts)})"


STATS_SQL = f"""{REF_SQL}, {_long('lref', 'ref')},
stats AS (SELECT feature, count(*) AS "count", count(*) - count(v) AS missing, avg(v) AS mean, stddev_pop(v) AS std, min(v) AS "min", max(v) AS "max",
  quantile_cont(v, 0.01) AS p01, quantile_cont(v, 0.25) AS p25, quantile_cont(v, 0.5) AS p50, quantile_cont(v, 0.75) AS p75, quantile_cont(v, 0.99) AS p99
  FROM lref GROUP BY feature),
edge AS (SELECT feature, i, CASE WHEN i = 20 THEN "max" ELSE i * (("max" - "min") / 20) + "min" END AS e FROM stats, range(0, 21) t(i)),
bin AS (SELECT a.feature, a.i AS bin, a.e AS lo, b.e AS hi FROM edge a JOIN edge b ON a.feature = b.feature AND b.i = a.i + 1),
rbin AS (SELECT b.feature, bin, lo, hi, count(v) AS n FROM bin b LEFT JOIN lref l ON l.feature = b.feature AND v >= lo AND (v < hi OR (bin = 19 AND v <= hi)) GROUP BY ALL)"""

DRIFT_SQL = f"""{STATS_SQL}, {CUR_SQL}, {_long('lcur', 'cur', 'ship_year,')},
cbin AS (SELECT b.feature, bin, lo, hi, b.n AS r, count(v) AS c FROM rbin b LEFT JOIN lcur l ON l.feature = b.feature AND v >= lo AND (v < hi OR (bin = 19 AND v <= hi)) GROUP BY ALL),
sh AS (SELECT feature, (c + 1e-6) / (sum(c) OVER w + 2e-5) AS p, (r + 1e-6) / (sum(r) OVER w + 2e-5) AS q FROM cbin WINDOW w AS (PARTITION BY feature)),
dist AS (SELECT feature, sum((p - q) * (ln(greatest(p, 1e-9)) - ln(greatest(q, 1e-9)))) AS psi,
  sum(p * (ln(greatest(p, 1e-9)) - ln(greatest(q, 1e-9)))) AS kl_divergence FROM sh GROUP BY feature),
qual AS (SELECT l.feature, avg(CASE WHEN v IS NULL THEN 1.0 ELSE 0.0 END) AS missing_rate,
  avg(CASE WHEN v IS NOT NULL THEN CASE WHEN v < mean - 3 * std OR v > mean + 3 * std THEN 1.0 ELSE 0.0 END END) AS out_of_bounds_pct
  FROM lcur l JOIN stats s USING (feature) GROUP BY l.feature),
report AS (SELECT d.feature, psi, kl_divergence, missing_rate, out_of_bounds_pct,
  CASE WHEN psi >= 0.2 THEN 'alert' WHEN psi >= 0.1 THEN 'warn' ELSE 'ok' END AS severity FROM dist d JOIN qual USING (feature))"""

YEAR_SQL = f"""{STATS_SQL}, {CUR_SQL}, {_long('lcur', 'cur', 'ship_year,')},
yr AS (SELECT DISTINCT ship_year FROM cur),
cbin AS (SELECT ship_year, b.feature, bin, b.n AS r, count(v) AS c FROM rbin b CROSS JOIN yr LEFT JOIN lcur l USING (ship_year, feature)
  WHERE false GROUP BY ALL
  UNION ALL
  SELECT y.ship_year, b.feature, b.bin, b.n, (SELECT count(*) FROM lcur l WHERE l.ship_year = y.ship_year AND l.feature = b.feature AND v >= lo AND (v < hi OR (bin = 19 AND v <= hi))) FROM rbin b CROSS JOIN yr y),
sh AS (SELECT ship_year, feature, (c + 1e-6) / (sum(c) OVER w + 2e-5) AS p, (r + 1e-6) / (sum(r) OVER w + 2e-5) AS q FROM cbin WINDOW w AS (PARTITION BY ship_year, feature)),
psi AS (SELECT ship_year, feature, sum((p - q) * (ln(greatest(p, 1e-9)) - ln(greatest(q, 1e-9)))) AS psi FROM sh GROUP BY ALL)"""


def _baseline(spark, sf):
    return D.baseline(reference_rows(spark, sf))


def _hist(spark, sf):
    return D.reference_histogram(reference_rows(spark, sf), FEATURES)


def _report(spark, sf):
    ref = _hist(spark, sf)
    return D.drift_report(current_rows(spark, sf), ref, D.constraints(ref))


def a17_baseline_stats(spark, sf):
    return rounded(_baseline(spark, sf).drop("edges", "counts"))


def _bins(h):
    return h.select("feature", "edges", F.posexplode("counts").alias("bin", "n")).select(
        "feature", F.col("bin").cast("long").alias("bin"), F.col("edges")[F.col("bin")].alias("lo"),
        F.col("edges")[F.col("bin") + 1].alias("hi"), "n")


def a18_histogram(spark, sf):
    return rounded(_bins(_hist(spark, sf)))


def b01_baseline(spark, sf):
    b = _baseline(spark, sf)
    full = F.aggregate("counts", F.lit(0).cast("long"), lambda a, x: a + x)
    return rounded(b.select("feature", "count", "missing", "mean", "std", "min", "max", "p01", "p25", "p50", "p75", "p99",
                            full.alias("binned"), F.array_max("counts").alias("fullest")))


def b02_constraints(spark, sf):
    return rounded(D.constraints(D.summary(reference_rows(spark, sf), FEATURES)))


def _pick(*cols):
    return lambda spark, sf: rounded(_report(spark, sf).select("feature", *cols))


def _yearly(spark, sf):
    h = _hist(spark, sf)
    cur = current_rows(spark, sf, F.year("l_shipdate").alias("ship_year"))
    return D.drift_report(cur, h, by=["ship_year"])


def b09_retrain_requests(spark, sf):
    rows = _yearly(spark, sf).select(
        F.lit("rcf-metrics").alias("model"), "feature", F.make_timestamp_ntz("ship_year", F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)).alias("ts"), "psi")
    return rounded(D.retrain_requests(rows, ["l_extendedprice", "l_discount"]))


def j01_baseline_features(spark, sf):
    """Current cells joined with their baseline by feature name."""
    ref = F.broadcast(D.summary(reference_rows(spark, sf), FEATURES).select("feature", "mean", "std"))
    cur = current_rows(spark, sf)
    cells = D.long_form(cur, D.numeric_features(cur)).join(ref, "feature")
    z = (F.col("v") - F.col("mean")) / F.col("std")
    return rounded(cells.groupBy("feature").agg(F.count("v").alias("n"), F.avg(z).alias("mean_z")))


def j02_baseline_without_limits(spark, sf):
    """Limits exist for two features only; the others report no share outside."""
    ref = _hist(spark, sf)
    limits = D.constraints(ref).where(F.col("feature").isin("l_quantity", "l_extendedprice"))
    out = D.drift_report(current_rows(spark, sf), ref, limits)
    return rounded(out.select("feature", "out_of_bounds_pct"))


def k07_report_document(spark, sf):
    return D.report_document(_report(spark, sf), "rcf-metrics", "dev").drop("document")


def u03_missing_features(spark, sf):
    base = D.summary(table(spark, sf, "lineitem").select(*FEATURES, "l_linenumber", "l_suppkey"), [*FEATURES, "l_linenumber", "l_suppkey"])
    return D.features_not_in(base, current_rows(spark, sf))


def p08_pii_field_names(spark, sf):
    e = table(spark, sf, "events").select(F.create_map(
        F.lit("k"), F.lit(1),
        F.expr("CASE event_type WHEN 'signup' THEN 'Email' WHEN 'purchase' THEN 'address' WHEN 'error' THEN 'dob' ELSE 'page' END"), F.lit(1)).alias("attrs"))
    return V.pii_keys(e, "attrs")


def p09_pii_values(spark, sf):
    d = table(spark, sf, "documents")
    return d.where(value_has_pii(F.col("text"))).select("doc_id")


def p13_error_lines(spark, sf):
    return common_events(spark, sf).where(has_error_word(F.col("message"))).select("event_id", "message")


def _docs(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "text", "lang", "source")


def s09_current_or_empty(spark, sf):
    """The current feature table, or the status 'no-data' when a partition is empty."""
    li = table(spark, sf, "lineitem")
    months = li.groupBy(F.date_trunc("month", "l_shipdate").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    span = li.agg(F.min(F.date_trunc("month", "l_shipdate")).alias("a"), F.max(F.date_trunc("month", "l_shipdate")).alias("b"))
    every = span.select(F.explode(F.expr("sequence(a - interval 2 months, b, interval 1 month)")).alias("month"))
    out = every.join(months, "month", "left")
    return rounded(out.select(F.col("month").cast("timestamp_ntz").alias("month"), F.when(F.col("n").isNull(), "no-data").otherwise("ok").alias("status"), F.coalesce("n", F.lit(0)).alias("n")))


QUERIES = {
    "a15_row_count_gate": lambda spark, sf: _docs(spark, sf).groupBy("lang").agg(F.count(F.lit(1)).alias("n"), (F.count(F.lit(1)) >= 100).alias("passed")),
    "a16_validation_report": lambda spark, sf: V.validation_report(_docs(spark, sf)),
    "a16_first_violations": lambda spark, sf: V.first_violations(_docs(spark, sf), "doc_id"),
    "a17_baseline_stats": a17_baseline_stats,
    "a18_histogram": a18_histogram,
    "b01_baseline": b01_baseline,
    "b02_constraints": b02_constraints,
    "b03_psi": _pick("psi"),
    "b04_kl_divergence": _pick("kl_divergence"),
    "b05_missing_rate": _pick("missing_rate"),
    "b06_out_of_bounds": _pick("out_of_bounds_pct"),
    "b07_severity": _pick("severity"),
    "b08_drift_report": _pick("psi", "kl_divergence", "missing_rate", "out_of_bounds_pct", "severity"),
    "b09_retrain_requests": b09_retrain_requests,
    "b11_storm_triage": lambda spark, sf: D.storm_triage(_report(spark, sf)),
    "j01_baseline_features": j01_baseline_features,
    "j02_baseline_without_limits": j02_baseline_without_limits,
    "k06_psi_metric_rows": lambda spark, sf: rounded(D.metric_rows(_report(spark, sf), "rcf-metrics", "dev")),
    "k07_report_document": k07_report_document,
    "u03_missing_features": u03_missing_features,
    "p08_pii_field_names": p08_pii_field_names,
    "p09_pii_values": p09_pii_values,
    "p13_error_lines": p13_error_lines,
    "s09_current_or_empty": s09_current_or_empty,
}

_PII = r"regexp_matches(text, '\b\d{3}[-. ]?\d{3}[-. ]?\d{4}\b') OR regexp_matches(text, '(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}')"
_R = {c: f"round({c}, 6) + 0.0 AS {c}" for c in ("psi", "kl_divergence", "missing_rate", "out_of_bounds_pct")}
_S = ", ".join(f'round("{c}", 6) AS "{c}"' for c in ("mean", "std", "min", "max", "p01", "p25", "p50", "p75", "p99"))

ORACLES = {
    "a15_row_count_gate": "SELECT lang, count(*) AS n, count(*) >= 100 AS passed FROM documents GROUP BY lang",
    "a16_validation_report": f"SELECT (SELECT count(*) FROM documents) AS row_count, 100 AS min_rows_required, (SELECT count(*) FROM documents WHERE {_PII}) AS pii_violation_count, (SELECT count(*) FROM documents) >= 100 AND (SELECT count(*) FROM documents WHERE {_PII}) = 0 AS passed",
    "a16_first_violations": f"SELECT doc_id AS \"row\", 'text' AS field, 'value matches PII pattern' AS reason FROM documents WHERE {_PII} ORDER BY doc_id LIMIT 50",
    "a17_baseline_stats": f'WITH {STATS_SQL} SELECT feature, "count", missing, {_S} FROM stats',
    "a18_histogram": f"WITH {STATS_SQL} SELECT feature, bin, round(lo, 6) AS lo, round(hi, 6) AS hi, n FROM rbin",
    "b01_baseline": f'WITH {STATS_SQL} SELECT s.feature, "count", missing, {_S}, binned, fullest FROM stats s JOIN (SELECT feature, CAST(sum(n) AS BIGINT) AS binned, max(n) AS fullest FROM rbin GROUP BY feature) USING (feature)',
    "b02_constraints": f'WITH {STATS_SQL} SELECT feature, round(mean - 3 * std, 6) AS "min", round(mean + 3 * std, 6) AS "max", CAST(0.05 AS DOUBLE) AS max_missing_rate FROM stats',
    "b03_psi": f"WITH {DRIFT_SQL} SELECT feature, {_R['psi']} FROM report",
    "b04_kl_divergence": f"WITH {DRIFT_SQL} SELECT feature, {_R['kl_divergence']} FROM report",
    "b05_missing_rate": f"WITH {DRIFT_SQL} SELECT feature, {_R['missing_rate']} FROM report",
    "b06_out_of_bounds": f"WITH {DRIFT_SQL} SELECT feature, {_R['out_of_bounds_pct']} FROM report",
    "b07_severity": f"WITH {DRIFT_SQL} SELECT feature, severity FROM report",
    "b08_drift_report": f"WITH {DRIFT_SQL} SELECT feature, {', '.join(_R.values())}, severity FROM report",
    "b09_retrain_requests": f"WITH {YEAR_SQL} SELECT 'rcf-metrics' AS model, feature, make_timestamp(ship_year, 1, 1, 0, 0, 0) AS hour, round(psi, 6) AS max_psi FROM psi WHERE feature IN ('l_extendedprice', 'l_discount') AND psi > 0.2",
    "b11_storm_triage": f"WITH {DRIFT_SQL} SELECT count(*) FILTER (psi > 0.3) AS drifted, count(*) AS features, count(*) FILTER (psi > 0.3) >= 3 AS looks_like_drift FROM report",
    "j01_baseline_features": f"WITH {STATS_SQL}, {CUR_SQL}, {_long('lcur', 'cur')} SELECT l.feature, count(v) AS n, round(avg((v - mean) / std), 6) AS mean_z FROM lcur l JOIN stats s USING (feature) GROUP BY l.feature",
    "j02_baseline_without_limits": f"WITH {DRIFT_SQL} SELECT feature, CASE WHEN feature IN ('l_quantity', 'l_extendedprice') THEN round(out_of_bounds_pct, 6) ELSE 0.0 END AS out_of_bounds_pct FROM report",
    "k06_psi_metric_rows": f"WITH {DRIFT_SQL} SELECT 'PSI' AS metric, 'rcf-metrics' AS model, 'dev' AS environment, feature, round(psi, 6) AS value, 0 AS chunk FROM report",
    "k07_report_document": f"WITH {DRIFT_SQL} SELECT 'rcf-metrics' AS model, 'dev' AS environment, CAST(count(*) AS INT) AS n_features, coalesce(string_agg(feature, ',' ORDER BY feature) FILTER (severity = 'alert'), '') AS alerts FROM report",
    "u03_missing_features": "SELECT feature FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('l_linenumber'), ('l_suppkey')) b(feature) EXCEPT SELECT feature FROM (VALUES ('l_quantity'), ('l_extendedprice'), ('l_discount'), ('l_tax'), ('new_feature')) c(feature)",
    "p08_pii_field_names": "SELECT CASE event_type WHEN 'signup' THEN 'Email' WHEN 'purchase' THEN 'address' ELSE 'dob' END AS field, count(*) AS n FROM events WHERE event_type IN ('signup', 'purchase', 'error') GROUP BY 1",
    "p09_pii_values": f"SELECT doc_id FROM documents WHERE {_PII}",
    "p13_error_lines": rf"WITH {COMMON_EVENTS_SQL} SELECT event_id, message FROM common_events WHERE regexp_matches(message, '(?i)\b(error|fail|denied|exception|panic|fatal|crash|timeout)\b')",
    "s09_current_or_empty": """WITH m AS (SELECT date_trunc('month', l_shipdate) AS month, count(*) AS n FROM lineitem GROUP BY 1),
      r AS (SELECT unnest(generate_series(min(month) - INTERVAL 2 MONTH, max(month), INTERVAL 1 MONTH)) AS month FROM m)
      SELECT CAST(r.month AS TIMESTAMP) AS month, CASE WHEN n IS NULL THEN 'no-data' ELSE 'ok' END AS status, coalesce(n, 0) AS n FROM r LEFT JOIN m ON m.month = r.month""",
}
