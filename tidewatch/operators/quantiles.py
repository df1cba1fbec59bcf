"""Exact, linearly interpolated percentiles that survive a hot group.

``percentile`` holds one entry per distinct value of a group in a single task,
which is fine for ordinary groups and not for one that owns a third of the
table.  Groups above a row limit (and a percentile over the whole table) are
selected by refinement instead: count rows per coarse value slice, keep only
the slices that contain a wanted rank, refine those linearly, then sort just
the few values left.  Each pass reads two columns and shuffles counts, not rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.skew import BLOCK_ROWS, join_on, split_hot
from tidewatch.session import settle

FINE_SLICES = 4096
_INF = float("inf")


def value_slice(v: Column) -> Column:
    """A slice number that never decreases as ``v`` grows: sixteen per power of two."""
    up = F.lit(40_000) + F.floor(F.log2(v) * 16)
    down = F.lit(-40_000) - F.floor(F.log2(-v) * 16)
    return (
        F.when(F.isnan(v), 100_001)
        .when(v == _INF, 100_000)
        .when(v == -_INF, -100_000)
        .when(v > 0, up)
        .when(v < 0, down)
        .otherwise(0)
        .cast("int")
    )


def fine_slice(v: Column, lo: Column, hi: Column, n: int = FINE_SLICES) -> Column:
    """Linear sub-slice of ``v`` inside [lo, hi], also monotone in ``v``."""
    scaled = F.floor((v - lo) / (hi - lo) * n)
    return F.when(hi > lo, F.least(scaled, F.lit(n - 1))).otherwise(0).cast("int")


def _partition(keys: Sequence[str]):
    return Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))


def _join_keys(left: DataFrame, right: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Inner join on null-safe keys; ``right`` has a few rows per hot group, of which there may be many."""
    right = right.select(*[F.col(c).alias(f"_r_{c}") if c in cols else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(right, cond).drop(*[f"_r_{c}" for c in cols])


def _hits_rank(qs: Sequence[float]) -> Column:
    """Does the run [_first, _first + _n) of a group of ``_total`` rows hold a wanted rank."""
    pos = [(F.col("_total") - 1) * F.lit(float(q)) for q in qs]
    out = F.lit(False)
    for p in pos:
        for f in (F.floor, F.ceil):
            out = out | ((f(p) >= F.col("_first")) & (f(p) < F.col("_first") + F.col("_n")))
    return out


def _ranked(counts: DataFrame, group: Sequence[str], order: str) -> DataFrame:
    """Move ``_first`` to the rank of the first row of each entry within its group."""
    run = _partition(group).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return counts.withColumn("_first", F.col("_first") + F.sum("_n").over(run) - F.col("_n"))


def _select_by_refinement(rows: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """Three passes over (keys, value); all need the same first counts, which Spark computes once."""
    wanted = _hits_rank(list(probs.values()))
    carry = [F.any_value("_first").alias("_first"), F.any_value("_total").alias("_total")]
    rows = rows.withColumn("_s", value_slice(F.col("_v")))

    coarse = rows.groupBy(*keys, "_s").agg(
        F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi"), F.lit(0).cast("long").alias("_first")
    ).withColumn("_total", F.sum("_n").over(_partition(keys)))
    coarse = _ranked(coarse, keys, "_s").where(wanted).drop("_n")

    near = _join_keys(rows, coarse, [*keys, "_s"])
    near = near.withColumn("_f", fine_slice(F.col("_v"), F.col("_lo"), F.col("_hi")))
    fine = near.groupBy(*keys, "_s", "_f").agg(F.count(F.lit(1)).alias("_n"), *carry)
    fine = _ranked(fine, [*keys, "_s"], "_f").where(wanted).drop("_n")

    left = _join_keys(near.select(*keys, "_s", "_f", "_v"), fine, [*keys, "_s", "_f"])
    left = left.groupBy(*keys, "_s", "_f", "_v").agg(F.count(F.lit(1)).alias("_n"), *carry)
    left = _ranked(left, [*keys, "_s", "_f"], "_v")

    return _interpolated(left, keys, probs)


def _interpolated(left: DataFrame, keys: Sequence[str], probs: Mapping[str, float]) -> DataFrame:
    """The percentiles of each group from its values near the wanted ranks."""
    qs = list(probs.items())
    aggs = []
    for i, (_, q) in enumerate(qs):
        p = (F.col("_total") - 1) * F.lit(float(q))
        for side, f in (("lo", F.floor), ("hi", F.ceil)):
            rank = f(p).cast("long")
            hit = (rank >= F.col("_first")) & (rank < F.col("_first") + F.col("_n"))
            aggs.append(F.max(F.when(hit, F.col("_v"))).alias(f"_{side}{i}"))
    aggs.append(F.max("_total").alias("_total"))
    out = left.groupBy(*keys).agg(*aggs)
    cols = []
    for i, (name, q) in enumerate(qs):
        p = (F.col("_total") - 1) * F.lit(float(q))
        lo, hi = F.col(f"_lo{i}"), F.col(f"_hi{i}")
        cols.append((lo + (hi - lo) * (p - F.floor(p))).alias(name))
    return out.select(*keys, *cols)


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: Mapping[str, float],
    hot_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """One row per group with one column per entry of ``probs`` (name -> 0..1).

    Groups without any non-null value have no row.  ``hot_rows=0`` treats every
    group as hot, for a handful of groups that each span the whole table.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    if not keys or hot_rows == 0:
        return _select_by_refinement(rows, list(keys), probs)
    cold, hot = split_hot(rows, keys, hot_rows)
    arr = F.percentile("_v", F.array(*[F.lit(float(q)) for q in probs.values()]))
    small = cold.groupBy(*keys).agg(arr.alias("_p"))
    small = small.select(*keys, *[F.col("_p")[i].alias(n) for i, n in enumerate(probs)])
    return small if hot is None else small.unionByName(_select_by_refinement(hot, keys, probs))


def rolling_percentiles(df: DataFrame, keys: Sequence[str], day: str, value: str, probs: Mapping[str, float], days: int) -> DataFrame:
    """Exact percentiles of ``value`` over the trailing ``days`` of each day: (keys, day, one column per entry of ``probs``).

    ``day`` is a day number; every day with rows gets a window, but none without any value in it.  Counts per value slice and day are summaries that add up: the
    windows are built from them, never from rows, and tell the slice that holds a wanted rank.  Only values of such slices are
    counted in finer slices, and only values of those one by one; at each level a day's counts go to the windows that asked for
    this slice.
    """
    rows = df.select(*keys, F.col(day).cast("long").alias("_day"), F.col(value).cast("double").alias("_v")).where(F.col("_v").isNotNull())
    rows = rows.withColumn("_s", value_slice(F.col("_v")))
    daily = settle(rows.groupBy(*keys, "_day", "_s").agg(F.count(F.lit(1)).alias("_n"), F.min("_v").alias("_lo"), F.max("_v").alias("_hi")))
    ends = df.select(*keys, F.col(day).cast("long").alias("_to")).distinct()
    edges = daily.groupBy(*keys, "_s").agg(F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    wanted, window = _hits_rank(list(probs.values())), [*keys, "_to"]

    reach = F.explode(F.sequence(F.col("_day"), F.col("_day") + days - 1)).alias("_to")
    coarse = join_on(daily.select(*keys, "_s", "_n", reach), ends, window).groupBy(*window, "_s").agg(F.sum("_n").alias("_n"))
    coarse = coarse.withColumn("_first", F.lit(0).cast("long")).withColumn("_total", F.sum("_n").over(Window.partitionBy(*window)))
    hits = settle(_ranked(coarse, window, "_s").where(wanted).drop("_n"))

    def asked(counts: DataFrame, hits: DataFrame, slices: Sequence[str], by: str) -> DataFrame:
        """Counts of the days inside each window that hit their slice, with the ranks of the window."""
        inside = (F.col("_day") <= F.col("_to")) & (F.col("_day") > F.col("_to") - days)
        met = join_on(counts, hits, [*keys, *slices]).where(inside)
        summed = met.groupBy(*window, *slices, by).agg(F.sum("_n").alias("_n"), F.any_value("_first").alias("_first"), F.any_value("_total").alias("_total"))
        return _ranked(summed, [*window, *slices], by)

    near = join_on(rows, join_on(edges, hits.select(*keys, "_s").distinct(), [*keys, "_s"]), [*keys, "_s"])
    near = near.withColumn("_f", fine_slice(F.col("_v"), F.col("_lo"), F.col("_hi")))
    fine = near.groupBy(*keys, "_day", "_s", "_f").agg(F.count(F.lit(1)).alias("_n"))
    fine_hits = settle(asked(fine, hits, ["_s"], "_f").where(wanted).drop("_n"))
    left = join_on(near.select(*keys, "_day", "_s", "_f", "_v"), fine_hits.select(*keys, "_s", "_f").distinct(), [*keys, "_s", "_f"])
    left = asked(left.groupBy(*keys, "_day", "_s", "_f", "_v").agg(F.count(F.lit(1)).alias("_n")), fine_hits, ["_s", "_f"], "_v")
    return _interpolated(left, window, probs).withColumnRenamed("_to", day)
