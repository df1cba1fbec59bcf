"""Limiters, as-of and trailing joins where one key holds most rows and is cut into many pieces."""

from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators.joins import latest_before, trailing_matches
from tidewatch.operators.skew import equal_depth_pieces, running_sums

T0 = datetime(2024, 1, 1, 10)
EPOCH = datetime(1970, 1, 1)


def seconds_of(seed, n, gaps=(0, 0, 1, 1, 2, 7, 300)):
    rng = np.random.default_rng(seed)
    out = {"hot": np.cumsum(rng.choice(gaps[:-1], n)), "warm": np.cumsum(rng.choice(gaps, n // 4)), "cold": np.array([5])}
    return [(k, int(s)) for k, v in out.items() for s in v]


@pytest.mark.parametrize("limit, seconds, block", [(3, 20, 150), (5, 60, 200), (1, 5, 1_000_000)])
def test_limiter_over_many_blocks(spark, limit, seconds, block):
    rows = seconds_of(limit, 500)
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s)) for k, s in rows], "user string, ts timestamp")
    want, used = {}, {}
    for k, s in rows:
        past = used.setdefault(k, [])
        ok = sum(s - t <= seconds for t in past) < limit
        past += [s] * ok
        n, a = want.get((k, s), (0, 0))
        want[k, s] = (n + 1, a + ok)
    base = int((T0 - EPOCH).total_seconds())
    got = {(r.user, r.second - base): (r.requests, r.admitted) for r in A.admitted_requests(df, "user", limit, seconds, block).collect()}
    assert got == want


@pytest.mark.parametrize("minutes, block", [(1, 61), (3, 500), (2, 1_000_000)])
def test_cooldown_over_many_blocks(spark, minutes, block):
    rows = seconds_of(minutes, 1500, (0, 1, 3, 10, 30, 59, 61, 4000))
    df = spark.createDataFrame([(k, T0 + timedelta(seconds=s), f"{i:05}") for i, (k, s) in enumerate(rows)], "metric_key string, created_at timestamp, id string")
    want, last = [], {}
    for i, (k, s) in enumerate(rows):
        if k not in last or s - last[k] > minutes * 60:
            last[k] = s
            want.append(f"{i:05}")
    assert sorted(r.id for r in A.with_cooldown(df, minutes, block).collect()) == want


def busy(seed, n):
    """A key with most rows inside one hour, many of them at one instant, and some at the same instants of another key."""
    rng = np.random.default_rng(seed)
    us = np.sort(np.where(rng.random(n) < 0.3, 777_000_000, rng.integers(0, 3_000_000_000, n)))
    return pd.DataFrame({"key": np.where(rng.random(n) < 0.85, "hot", "b"), "ts": pd.Timestamp(T0) + pd.to_timedelta(us, unit="us"), "id": np.arange(n)})


@pytest.mark.parametrize("limit", [7, 40])
def test_pieces_are_bounded_and_in_order(spark, limit):
    pdf = busy(1, 1200)
    out = equal_depth_pieces(spark.createDataFrame(pdf), ["key"], "ts", "hour", limit, F.when(F.col("id") % 50 == 0, F.col("id") % 100 == 0)).collect()
    assert len(out) == 1200
    sizes = pd.Series([(r.key, tuple(r._piece)) for r in out]).value_counts()
    assert sizes.max() <= 3 * limit
    for key in ("hot", "b"):
        rows = sorted((tuple(r._piece), r.ts) for r in out if r.key == key)
        assert [t for _, t in rows] == sorted(t for _, t in rows)


@pytest.mark.parametrize("limit, strict", [(9, False), (30, True)])
def test_as_of_join_on_a_busy_key(spark, limit, strict):
    pdf = busy(2, 1500)
    left, right = pdf.iloc[::2], pdf.iloc[1::3].assign(seen=lambda d: d["id"] % 17).drop(columns="id")
    got = latest_before(spark.createDataFrame(left), spark.createDataFrame(right), ["key"], "ts", ["seen"], strict, "hour", limit).toPandas().sort_values("id")
    ref = right.groupby(["key", "ts"], as_index=False)["seen"].max().sort_values("ts")
    want = pd.merge_asof(left.sort_values("ts"), ref, on="ts", by="key", allow_exact_matches=not strict).sort_values("id")
    assert np.allclose(got["seen"].to_numpy(float), want["seen"].to_numpy(float), equal_nan=True) and len(got) == len(left)


@pytest.mark.parametrize("limit", [25, 10**6])
def test_trailing_matches_on_a_busy_key(spark, limit):
    pdf = busy(3, 1000)
    left, right = pdf.iloc[::2], pdf.iloc[1::3]
    got = trailing_matches(spark.createDataFrame(left), spark.createDataFrame(right[["key", "ts"]]), ["key"], "ts", 120, limit_rows=limit).collect()
    assert len(got) == len(left)
    span = pd.Timedelta(seconds=120)
    for r in got:
        near = right[(right["key"] == r.key) & (right["ts"] <= r.ts) & (right["ts"] >= pd.Timestamp(r.ts) - span)]
        assert (r.matches, r.latest_match) == (len(near), near["ts"].max().to_pydatetime() if len(near) else None)


def test_running_sums_over_pieces(spark):
    pdf = busy(4, 800).drop_duplicates(["key", "ts"])
    got = {r.id: r.total for r in running_sums(spark.createDataFrame(pdf), ["key"], "ts", "id", "total", "hour", 13).collect()}
    assert got == dict(zip(pdf["id"], pdf.groupby("key")["id"].cumsum()))
