"""Feature baselines and distribution drift."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.session import settle

# Histogram width, bounds and thresholds of the drift check.
BINS = 20
TOLERANCE_SIGMA = 3.0
MAX_MISSING_RATE = 0.05
PSI_WARN, PSI_ALERT = 0.10, 0.20
STORM_PSI = 0.30
SMOOTHING, LOG_FLOOR = 1e-6, 1e-9
QUANTILES = {"p01": 0.01, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p99": 0.99}

_INF = float("inf")


def numeric_features(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType)]


def long_form(df: DataFrame, features: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(*keep, feature, v) with NaN as null; stays inside one stage."""
    cells = [
        F.struct(F.lit(f).alias("feature"), F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias("v"))
        for f in features
    ]
    return df.select(*keep, F.inline(F.array(*cells)))


def _finite(v: Column) -> Column:
    return F.when(v.isNotNull() & (F.abs(v) < _INF), v)


def with_bin(df: DataFrame) -> DataFrame:
    """Replace ``edges`` by ``bin``: the zero-based bin of ``v``, null outside the edges.

    Equal-width bins, closed on the left, the last one on both sides.  The
    quotient may land one bin off next to an edge, so the stored edges decide.
    Steps are separate projections to keep each expression evaluated once.
    """
    n = F.greatest(F.size("edges") - 1, F.lit(0))
    # a feature without finite values has no edges, and no value falls between them
    lo, hi, v = F.get("edges", F.lit(0)), F.try_element_at("edges", F.lit(-1)), F.col("v")
    out = df.withColumns({"_lo": lo, "_hi": hi, "_n": n})
    inside = (v >= F.col("_lo")) & (v <= F.col("_hi"))
    width = F.nullif(F.col("_hi") - F.col("_lo"), F.lit(0.0))
    guess = F.floor((v - F.col("_lo")) / width * F.col("_n")).cast("int")
    out = out.withColumn("_g", F.when(inside, F.least(F.coalesce(guess, F.lit(0)), F.col("_n") - 1)))
    out = out.withColumns({"_left": F.get("edges", F.col("_g")), "_right": F.get("edges", F.col("_g") + 1)})
    g = F.col("_g")
    fixed = F.when((g > 0) & (v < F.col("_left")), g - 1).when((g < F.col("_n") - 1) & (v >= F.col("_right")), g + 1).otherwise(g)
    return out.withColumn("bin", fixed).drop("edges", "_lo", "_hi", "_n", "_g", "_left", "_right")


def summary(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """count, missing, mean, population std (0 becomes 1e-9), min and max, from one wide pass."""
    wide = df.select([F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    cells = []
    for f in features:
        c = F.col(f)
        cells.append(F.struct(
            F.lit(f).alias("feature"), F.count(F.lit(1)).alias("count"), F.count_if(c.isNull()).alias("missing"),
            F.avg(c).alias("mean"), F.stddev_pop(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"),
            F.min(_finite(c)).alias("lo"), F.max(_finite(c)).alias("hi"),
        ))
    out = wide.agg(F.array(*cells).alias("cells")).select(F.inline("cells"))
    out = out.where(F.col("count") > F.col("missing"))
    return out.withColumn("std", F.when(F.col("std") == 0, 1e-9).otherwise(F.col("std")))


def with_edges(stats: DataFrame, bins: int = BINS) -> DataFrame:
    lo = F.col("lo")
    hi = F.when(F.col("hi") == lo, lo + F.lit(1e-9)).otherwise(F.col("hi"))
    step = (hi - lo) / F.lit(bins)
    edges = F.transform(F.sequence(F.lit(0), F.lit(bins)), lambda i: F.when(i == bins, hi).otherwise(i * step + lo))
    return stats.withColumn("edges", F.when(lo.isNull(), F.array().cast("array<double>")).otherwise(edges))


def histogram(df: DataFrame, features: Sequence[str], stats: DataFrame, bins: int = BINS) -> DataFrame:
    """(feature, edges, counts) with one count per bin, zeros included; no finite value, no row."""
    # One row per feature column, so the broadcast side is bounded by the schema.
    ref = F.broadcast(with_edges(stats, bins).select("feature", "lo", "hi", "edges"))
    cells = long_form(df, features).withColumn("v", _finite(F.col("v"))).where(F.col("v").isNotNull())
    cells = with_bin(cells.join(ref, "feature"))
    counts = cells.groupBy("feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi")
    )
    per = counts.groupBy("feature").agg(
        F.any_value("lo").alias("lo"), F.any_value("hi").alias("hi"),
        F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"),
    )
    dense = F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)))
    return with_edges(per, bins).select("feature", "edges", dense.alias("counts"))


def baseline(df: DataFrame, features: Sequence[str] | None = None, bins: int = BINS) -> DataFrame:
    """One row per feature: moments, quantiles and an equal-width histogram."""
    features = list(features or numeric_features(df))
    stats = settle(summary(df, features))
    # Few groups, each as long as the table: select their quantiles by refinement.
    quantiles = exact_percentiles(long_form(df, features), ["feature"], "v", QUANTILES, hot_rows=0)
    out = stats.drop("lo", "hi").join(F.broadcast(quantiles), "feature")
    out = out.join(F.broadcast(histogram(df, features, stats, bins)), "feature", "left")
    return out.withColumns({
        "edges": F.coalesce("edges", F.array().cast("array<double>")),
        "counts": F.coalesce("counts", F.array().cast("array<bigint>")),
    })


def reference_histogram(df: DataFrame, features: Sequence[str], bins: int = BINS) -> DataFrame:
    """(feature, mean, std, edges, counts): the part of a baseline that drift checks read, computed once."""
    stats = settle(summary(df, features))
    out = stats.select("feature", "mean", "std").join(F.broadcast(histogram(df, features, stats, bins)), "feature", "left")
    return settle(out.withColumns({
        "edges": F.coalesce("edges", F.array().cast("array<double>")),
        "counts": F.coalesce("counts", F.array().cast("array<bigint>")),
    }))


def constraints(base: DataFrame, sigma: float = TOLERANCE_SIGMA) -> DataFrame:
    return base.select(
        "feature",
        (F.col("mean") - sigma * F.col("std")).alias("min"),
        (F.col("mean") + sigma * F.col("std")).alias("max"),
        F.lit(MAX_MISSING_RATE).alias("max_missing_rate"),
    )


def _share(c: Column, total: Column, k: Column) -> Column:
    return (c + SMOOTHING) / (total + SMOOTHING * k)


def _log(p: Column) -> Column:
    return F.ln(F.greatest(p, F.lit(LOG_FLOOR)))


def severity(psi: Column, warn: float = PSI_WARN, alert: float = PSI_ALERT) -> Column:
    return F.when(psi >= alert, "alert").when(psi >= warn, "warn").otherwise("ok")


def drift_report(
    current: DataFrame,
    base: DataFrame,
    limits: DataFrame | None = None,
    by: Sequence[str] = (),
    psi_warn: float = PSI_WARN,
    psi_alert: float = PSI_ALERT,
) -> DataFrame:
    """PSI, KL(current || baseline), missing rate, out-of-bounds share and severity per feature.

    ``base`` needs (feature, edges, counts); ``limits`` (feature, min, max) is
    optional.  ``by`` splits the current rows, for example by hour.  One scan,
    one shuffle of at most features x bins counts per group.
    """
    features = [c for c in numeric_features(current) if c not in by]
    ref = base.select("feature", "edges", "counts")
    if limits is None:
        ref = ref.withColumn("low", F.lit(None).cast("double")).withColumn("high", F.lit(None).cast("double"))
    else:
        lim = limits.select("feature", F.col("min").alias("low"), F.col("max").alias("high"))
        ref = ref.join(lim, "feature", "left")
    # One row per feature column on the broadcast side: bounded by the schema.
    cells = long_form(current, features, by).withColumns({"is_missing": F.col("v").isNull(), "v": _finite(F.col("v"))})
    cells = with_bin(cells.join(F.broadcast(ref.drop("counts")), "feature"))
    cells = cells.withColumns({"is_finite": F.col("v").isNotNull(),
                               "is_out": (F.col("v") < F.col("low")) | (F.col("v") > F.col("high"))})
    counts = cells.groupBy(*by, "feature", "bin").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("is_missing").alias("missing"),
        F.count_if("is_finite").alias("finite"), F.count_if("is_out").alias("out"),
    )
    per = counts.groupBy(*by, "feature").agg(
        F.sum("n").alias("n"), F.sum("missing").alias("missing"), F.sum("finite").alias("finite"), F.sum("out").alias("out"),
        F.map_from_entries(F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "n")))).alias("m"),
    )
    per = per.join(F.broadcast(ref.select("feature", "counts")), "feature")
    k = F.size("counts")
    cur = F.transform(F.col("counts"), lambda _, i: F.coalesce(F.try_element_at("m", i), F.lit(0)).cast("double"))
    per = per.withColumn("cur", cur).withColumn("k", k)
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    per = per.withColumn("cur_n", total(F.col("cur"))).withColumn("ref_n", total(F.transform("counts", lambda x: x.cast("double"))))
    p = lambda x: _share(x, F.col("cur_n"), F.col("k"))
    q = lambda x: _share(x, F.col("ref_n"), F.col("k"))
    psi = F.zip_with("cur", "counts", lambda c, r: (p(c) - q(r)) * (_log(p(c)) - _log(q(r))))
    kl = F.zip_with("cur", "counts", lambda c, r: p(c) * (_log(p(c)) - _log(q(r))))
    out = per.select(
        *by, "feature", total(psi).alias("psi"), total(kl).alias("kl_divergence"),
        (F.col("missing") / F.col("n")).alias("missing_rate"),
        F.coalesce(F.try_divide("out", "finite"), F.lit(0.0)).alias("out_of_bounds_pct"),
    )
    return out.withColumn("severity", severity(F.col("psi"), psi_warn, psi_alert))


def features_not_in(base: DataFrame, current: DataFrame) -> DataFrame:
    """Baseline features the current table lacks."""
    names = [F.lit(c) for c in current.columns]
    return base.select("feature").where(~F.array_contains(F.array(*names), F.col("feature")))


def metric_rows(report: DataFrame, model: str, environment: str, chunk: int = 20) -> DataFrame:
    """PSI as metric rows in numbered chunks; a report has one row per feature column."""
    rank = F.row_number().over(Window.orderBy("feature"))
    return report.select(
        F.lit("PSI").alias("metric"), F.lit(model).alias("model"), F.lit(environment).alias("environment"), "feature",
        F.col("psi").alias("value"), F.floor((rank - 1) / chunk).cast("int").alias("chunk"),
    )


def report_document(report: DataFrame, model: str, environment: str) -> DataFrame:
    """One JSON document with every feature row and the list of alerting features."""
    rows = F.sort_array(F.collect_list(F.struct(*report.columns)))
    doc = report.agg(rows.alias("reports"))
    alerts = F.transform(F.filter("reports", lambda r: r["severity"] == "alert"), lambda r: r["feature"])
    return doc.select(
        F.lit(model).alias("model"), F.lit(environment).alias("environment"),
        F.size("reports").alias("n_features"), F.array_join(alerts, ",").alias("alerts"),
        F.to_json(F.struct(F.lit(model).alias("model"), F.lit(environment).alias("environment"),
                           F.lit(PSI_WARN).alias("psi_warn"), F.lit(PSI_ALERT).alias("psi_alert"),
                           F.col("reports"), alerts.alias("alerts"))).alias("document"),
    )


def retrain_requests(psi_rows: DataFrame, canaries: Sequence[str], threshold: float = PSI_ALERT) -> DataFrame:
    """Models to retrain: a canary feature whose hourly maximum PSI is strictly above the threshold.

    ``psi_rows``: (model, feature, ts, psi).
    """
    hourly = psi_rows.where(F.col("feature").isin(*canaries)).groupBy(
        "model", "feature", F.window("ts", "1 hour")["start"].alias("hour")
    ).agg(F.max("psi").alias("max_psi"))
    return hourly.where(F.col("max_psi") > threshold)


def storm_triage(report: DataFrame, many: int = 3, threshold: float = STORM_PSI) -> DataFrame:
    """Does an alert storm look like input drift: PSI beyond the storm level in many features."""
    n = F.count_if(F.col("psi") > threshold)
    return report.agg(n.cast("long").alias("drifted"), F.count(F.lit(1)).alias("features"), (n >= many).alias("looks_like_drift"))
