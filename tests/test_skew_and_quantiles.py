"""Split groups must give the answers of unsplit ones."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewatch.operators.evaluate import auc, seeded_split
from tidewatch.operators.joins import latest_before, trailing_matches
from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.operators.skew import row_blocks, time_blocks


@pytest.fixture(scope="module")
def skewed(spark):
    """One key owns most rows, one is null, times repeat within a second."""
    rng = np.random.default_rng(7)
    n = 1500
    key = np.where(rng.random(n) < 0.7, "hot", np.where(rng.random(n) < 0.5, "cold", None))
    ts = pd.Timestamp("2024-01-01") + pd.to_timedelta(np.sort(rng.integers(0, 4000, n)), unit="s")
    pdf = pd.DataFrame({"key": key, "ts": ts, "id": np.arange(n), "value": rng.normal(0, 50, n).round(2)})
    return spark.createDataFrame(pdf), pdf


def test_row_blocks_keep_rolling_frames(skewed):
    df, pdf = skewed
    b = row_blocks(df, ["key"], "ts", ["ts", "id"], halo=9, block_rows=100)
    w = Window.partitionBy("key", "_block").orderBy("ts", "id")
    out = b.withColumns({"s": F.sum("value").over(w.rowsBetween(-9, 0)), "n": F.count("*").over(w.rowsBetween(-9, 0))})
    got = out.where("NOT _halo").toPandas().sort_values("id")
    assert len(got) == len(pdf) and got["_block"].max() >= 8
    want = pdf.groupby("key", dropna=False)["value"].rolling(10, min_periods=1).sum().reset_index(level=0, drop=True).sort_index()
    assert np.allclose(got["s"].to_numpy(), want.to_numpy())
    assert got.groupby(["key", "_block"], dropna=False).size().max() <= 500  # the null key stays whole, the hot one is cut
    assert got[got["key"] == "hot"].groupby("_block").size().max() <= 100


def test_row_blocks_refuse_a_halo_beyond_the_block(skewed):
    with pytest.raises(ValueError):
        row_blocks(skewed[0], ["key"], "ts", ["ts", "id"], halo=100, block_rows=100)


def test_time_blocks_keep_range_frames(skewed):
    df, pdf = skewed
    b = time_blocks(df.withColumn("sec", F.unix_seconds(F.col("ts").cast("timestamp"))), "sec", 600, 300)
    w = Window.partitionBy("key", "_block").orderBy("sec").rangeBetween(-300, 0)
    got = b.withColumn("n", F.count("*").over(w)).where("NOT _halo").toPandas().sort_values("id")
    sec = (pdf["ts"] - pd.Timestamp("2024-01-01")).dt.total_seconds()
    want = [int(((pdf["key"].isna() if k is None else pdf["key"] == k) & (sec <= s) & (sec >= s - 300)).sum())
            for k, s in zip(pdf["key"].where(pdf["key"].notna(), None), sec)]
    assert got["n"].tolist() == want


@pytest.mark.parametrize("values", [
    [], [3.0], [1.0, 2.0], list(range(100)), [5.0] * 40, [-7.5, 0.0, 0.0, 2e-9, 1e12, -1e12, 4.0],
    [100 + i * 1e-6 for i in range(200)],
])
def test_percentiles_equal_numpy(spark, values):
    df = spark.createDataFrame([("g", float(v)) for v in values] + [("n", None)], "k string, v double")
    probs = {"p50": 0.5, "p95": 0.95, "p99": 0.99, "p0": 0.0, "p100": 1.0}
    want = [np.percentile(values, q * 100) for q in probs.values()] if values else None
    for hot_rows in (1_000_000, 3, 0):
        got = exact_percentiles(df, ["k"], "v", probs, hot_rows).where("k = 'g'").collect()
        if want is None:
            assert not got
        else:
            assert np.allclose([got[0][n] for n in probs], want, rtol=1e-12)
    whole = exact_percentiles(df, [], "v", probs).collect()
    assert len(whole) == 1
    if want:
        assert np.allclose([whole[0][n] for n in probs], want, rtol=1e-12)


def test_percentiles_with_null_keys_and_one_hot_group(skewed):
    df, pdf = skewed
    got = {r.key: (r.a, r.b) for r in exact_percentiles(df, ["key"], "value", {"a": 0.25, "b": 0.9}, 400).collect()}
    for k, part in pdf.groupby("key", dropna=False):
        assert np.allclose(got[None if pd.isna(k) else k], np.percentile(part["value"], [25, 90]))


def test_as_of_join_equals_pandas(spark, skewed):
    df, pdf = skewed
    right_pdf = pdf.iloc[::7][["key", "ts", "value"]].dropna().rename(columns={"value": "seen"})
    left = df.where("key IS NOT NULL").select("key", "ts", "id")
    right = spark.createDataFrame(right_pdf)
    got = latest_before(left, right, ["key"], "ts", ["seen"], piece="minute").toPandas().sort_values("id")
    # Several right rows at one instant: the largest value stands for them.
    ref = right_pdf.groupby(["key", "ts"], as_index=False)["seen"].max().sort_values("ts")
    want = pd.merge_asof(pdf.dropna(subset=["key"]).sort_values("ts"), ref, on="ts", by="key").sort_values("id")
    assert np.allclose(got["seen"].to_numpy(), want["seen"].to_numpy(), equal_nan=True)


def test_trailing_matches_counts_and_latest(spark):
    t = lambda m: datetime(2024, 1, 1, 10) + timedelta(minutes=m)
    left = spark.createDataFrame([("h", t(0), 1), ("h", t(60), 2), ("h", t(61), 3), ("g", t(5), 4)], "host string, ts timestamp, id int")
    right = spark.createDataFrame([("h", t(0)), ("h", t(59)), ("x", t(5))], "host string, ts timestamp")
    got = {r.id: (r.matches, r.latest_match) for r in trailing_matches(left, right, ["host"], "ts", 3600).collect()}
    assert got == {1: (1, t(0)), 2: (2, t(59)), 3: (1, t(59)), 4: (0, None)}


def test_auc_against_pairs(spark):
    rng = np.random.default_rng(3)
    s, y = rng.integers(0, 30, 300) / 7.0, rng.random(300) < 0.3
    got = auc(spark.createDataFrame([(float(a), bool(b)) for a, b in zip(s, y)], "s double, y boolean"), "y", "s").first().auc
    d = s[y][:, None] - s[~y][None, :]
    assert got == pytest.approx(((d > 0) + 0.5 * (d == 0)).mean())
    one = auc(spark.createDataFrame([(1.0, True)], "s double, y boolean"), "y", "s").first().auc
    assert one == 0.0


@pytest.mark.parametrize("n,kind,test_rows", [(10, "features", 10), (60, "features", 20), (500, "features", 100), (500, "text", 100), (100, "traces", 15)])
def test_split_sizes(spark, n, kind, test_rows):
    out = seeded_split(spark.range(n), ["id"], kind)
    counts = {r.is_test: r["count"] for r in out.groupBy("is_test").count().collect()}
    assert counts.get(True, 0) == test_rows and sum(counts.values()) == n
