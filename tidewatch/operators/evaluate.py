"""Splits, synthetic labels, detector metrics and the release gate."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import exact_percentiles, fine_slice, value_slice

# Share and least size of the test part by kind of data.
SPLITS = {"features": (0.20, 20), "text": (0.20, 50), "traces": (0.15, 10)}
# Primary metric and least value that lets a detector be registered.
GATES = {
    "rcf-metrics": ("f1", ">=", 0.70),
    "iforest-logs": ("precision_at_top1pct", ">=", 0.80),
    "log-embedding": ("precision_at_top1pct", ">=", 0.75),
    "trace-autoencoder": ("auc", ">=", 0.80),
}


def seeded_split(df: DataFrame, keys: Sequence[str], kind: str = "features", seed: int = 42) -> DataFrame:
    """Add ``is_test``; the test part has exactly max(least, floor(share * n)) rows.

    The rows with the smallest key hashes are the test part.  Counting hashes
    in 65,536 buckets finds the bucket the border lies in; only that bucket is
    sorted.  ``keys`` must identify a row.
    """
    share, least = SPLITS[kind]
    h = F.xxhash64(*keys, F.lit(seed))
    rank = F.struct(h.alias("h"), *keys)
    bucket = F.shiftright(h, 48)
    counts = df.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n"))
    run = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)  # at most 65,536 rows
    counts = counts.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy()))
    wanted = F.least(F.greatest(F.floor(F.col("total") * share), F.lit(least)), F.col("total"))
    border = counts.withColumn("wanted", wanted).where((F.col("upto") >= F.col("wanted")) & (F.col("upto") - F.col("n") < F.col("wanted")))
    border = border.select("b", (F.col("wanted") - F.col("upto") + F.col("n")).alias("take"))
    inside = df.select(rank.alias("o"), bucket.alias("b")).join(F.broadcast(border), "b")  # one row
    last = inside.withColumn("r", F.row_number().over(Window.partitionBy("b").orderBy("o"))).where(F.col("r") == F.col("take"))
    last = last.select(F.col("o").alias("_last"))
    return df.join(F.broadcast(last), how="left").withColumn("is_test", rank <= F.col("_last")).drop("_last")


def max_z(df: DataFrame, features: Sequence[str], out: str = "z") -> DataFrame:
    """Largest absolute z-score over the features (population std plus 1e-9)."""
    stats = df.agg(*[F.avg(f).alias(f"_m_{f}") for f in features], *[(F.stddev_pop(f) + 1e-9).alias(f"_s_{f}") for f in features])
    z = [F.abs((F.col(f) - F.col(f"_m_{f}")) / F.col(f"_s_{f}")) for f in features]
    wide = df.join(F.broadcast(stats))  # one row
    return wide.withColumn(out, F.greatest(*z) if len(z) > 1 else z[0]).drop(*[f"_{k}_{f}" for k in "ms" for f in features])


def flag_top(df: DataFrame, score: str, q: float, out: str) -> DataFrame:
    """Add a flag for scores at or above the exact ``q`` percentile of the table."""
    limit = exact_percentiles(df, [], score, {"_limit": q})
    return df.join(F.broadcast(limit)).withColumn(out, F.col(score) >= F.col("_limit")).drop("_limit")  # one row


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_report(df: DataFrame, truth: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """n_test, precision, recall, f1 and anomaly share; a ratio without cases is 0."""
    t, p = F.col(truth), F.col(predicted)
    base = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_test"), F.count_if(t & p).alias("tp"), F.count_if(p).alias("p"), F.count_if(t).alias("t"))
    return base.select(
        *by, "n_test", _ratio(F.col("tp"), F.col("p")).alias("precision"), _ratio(F.col("tp"), F.col("t")).alias("recall"),
        _ratio(2 * F.col("tp"), F.col("p") + F.col("t")).alias("f1"), _ratio(F.col("p"), F.col("n_test")).alias("anomaly_pct"))


def auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """Area under the ROC curve with ties at half weight; 0 if a class is empty.

    Rows collapse to (score, positives, negatives).  The running count of
    negatives is first taken over value slices, then inside each slice, so
    the scores are never sorted in one task.
    """
    t = F.col(truth)
    per = df.where(F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(
        F.count_if(t).alias("pos"), F.count_if(~t).alias("neg")).withColumn("s", value_slice(F.col("v")))
    edges = per.groupBy("s").agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    per = per.join(F.broadcast(edges), "s").withColumn("f", fine_slice(F.col("v"), F.col("lo"), F.col("hi"), 64)).drop("lo", "hi")
    # At most 64 fine slices for each of the value slices, whatever the row count.
    slices = per.groupBy("s", "f").agg(F.sum("neg").alias("n"))
    before = Window.orderBy("s", "f").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.select("s", "f", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("below"))
    inside = Window.partitionBy("s", "f").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    ranked = per.join(slices, ["s", "f"]).withColumn("under", F.col("below") + F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    area = F.sum(F.col("pos") * (F.col("under") + F.col("neg") / 2))
    pairs = F.sum("pos") * F.sum("neg")
    return ranked.agg(F.coalesce(F.try_divide(area, pairs), F.lit(0.0)).alias("auc"))


def gate(metrics: DataFrame, gates: dict[str, tuple[str, str, float]] = GATES) -> DataFrame:
    """(model, metric, value, threshold, decision) for long metrics (model, metric, value)."""
    rules = F.create_map(*[F.lit(x) for kv in ((m, g[0]) for m, g in gates.items()) for x in kv])
    limits = F.create_map(*[F.lit(x) for kv in ((m, float(g[2])) for m, g in gates.items()) for x in kv])
    below = F.array(*[F.lit(m) for m, g in gates.items() if g[1] == "<="], F.lit("-"))
    out = metrics.where(F.col("metric") == F.try_element_at(rules, F.col("model"))).withColumn("threshold", F.try_element_at(limits, F.col("model")))
    ok = F.when(F.array_contains(below, F.col("model")), F.col("value") <= F.col("threshold")).otherwise(F.col("value") >= F.col("threshold"))
    return out.withColumn("decision", F.when(ok, "register").otherwise("reject"))
