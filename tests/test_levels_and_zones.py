"""Rolling levels, sparse trace models, retention moves, the alert table and typed merges."""

import datetime as dt
import json
from datetime import datetime, timedelta
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import slo, traces
from tidewatch.operators.quantiles import rolling_percentiles
from tidewatch.schema import ALERT
from tidewatch.sources import dialects as D
from tidewatch.sources import sinks

T0 = datetime(2024, 1, 1)


def test_rolling_percentiles_equal_numpy(spark):
    rng = np.random.default_rng(1)
    rows = [(k, int(d), float(v)) for k in ("a", None) for d in rng.choice([0, 1, 2, 5, 9, 40], 60) for v in np.round(rng.lognormal(2, 2, 8), 3)]
    rows += [("a", 3, None), ("a", 90, None), ("z", 1, float("inf")), ("z", 1, -2.0), ("z", 2, 0.0)]
    df = spark.createDataFrame(rows, "k string, d int, v double")
    got = {(r.k, r.d): (r.mid, r.top) for r in rolling_percentiles(df, ["k"], "d", "v", {"mid": 0.5, "top": 0.99}, 4).collect()}
    want = {}
    for k, d in {(r[0], r[1]) for r in rows}:
        inside = [v for k2, d2, v in rows if k2 == k and d - 4 < d2 <= d and v is not None]
        if inside:
            want[k, d] = tuple(np.percentile(inside, [50, 99]))
    assert set(got) == set(want)
    assert all(np.allclose(got[x], want[x], rtol=1e-12, equal_nan=True) for x in want if x[0] != "z")


def test_levels_of_days_without_latencies(spark):
    rows = [("s", 200, 10.0, T0), ("s", 500, None, T0 + timedelta(days=2)), ("s", 404, 30.0, T0 + timedelta(days=40))]
    got = slo.rolling_service_levels(spark.createDataFrame(rows, "service string, status int, latency_ms double, ts timestamp")).orderBy("day").collect()
    assert [(r.requests, r.availability, r.error_rate, r.p99_latency_ms) for r in got] == [(1, 1.0, 0.0, 10.0), (2, 0.5, 0.5, 10.0), (1, 1.0, 0.0, 30.0)]


def sequences(spark, n, services, ops, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(t, [(p, int(rng.integers(services)), int(rng.integers(ops)) if p % 3 else t % 3, float(rng.lognormal(7, 2)), int(rng.random() < 0.2))
                 for p in range(int(rng.integers(3, 9)))]) for t in range(n)]
    return spark.createDataFrame(rows, "trace_id long, spans array<struct<pos int, svc int, op_id int, dur_ms double, status int>>").repartition(3)


def test_sparse_autoencoder_equals_the_dense_one(spark):
    seq = sequences(spark, 80, 4, 7)
    sparse = traces.sparse_spans(seq, 4, 7)
    mean, parts = traces.fit_sparse_autoencoder(sparse, 13, 3, rounds=12)
    dense = np.array([x for r in traces.encode(seq, 4, 7).collect() for x, m in zip(r.x, r.mask) if m])
    assert np.allclose(mean, dense.mean(axis=0))
    best = np.linalg.svd(dense - dense.mean(axis=0), full_matrices=False)[2][:3].T
    assert np.allclose(parts @ parts.T, best @ best.T, atol=1e-6)
    a = {r.trace_id: r.score for r in traces.sparse_reconstruction_error(sparse, mean, parts).collect()}
    b = {r.trace_id: r.score for r in traces.reconstruction_error(traces.encode(seq, 4, 7), mean, parts).collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_sparse_autoencoder_over_many_operations(spark):
    seq = sequences(spark, 60, 50, 100_000)
    sparse = traces.sparse_spans(seq, 50, 100_000)
    mean, parts = traces.fit_sparse_autoencoder(sparse, 100_052, 4, rounds=2)
    assert parts.shape == (100_052, 4) and np.allclose(parts.T @ parts, np.eye(4))
    scores = traces.sparse_reconstruction_error(sparse, mean, parts).collect()
    assert len(scores) == 60 and all(r.score >= 0 for r in scores)


def test_retention_moves_old_folders_only(spark, tmp_path):
    rows = [(i, "app", T0 + timedelta(days=i)) for i in range(40)]
    df = sinks.with_hour_partitions(spark.createDataFrame(rows, "id long, source string, ts timestamp"), F.col("ts"))
    zone, archive = f"{tmp_path}/zone", f"{tmp_path}/archive"
    df.write.partitionBy("source", "year", "month", "day", "hour").parquet(zone)
    today = dt.date(2024, 2, 9)
    folders = list(sinks.expired_folders(spark, zone, today - dt.timedelta(days=30)))
    assert len(folders) == 9 and folders[0] == "source=app/year=2024/month=01/day=01"
    # a run that broke off: the list is written, one folder has gone, one stands in both places
    (tmp_path / "archive" / folders[0]).parent.mkdir(parents=True)
    (tmp_path / "zone" / folders[0]).rename(tmp_path / "archive" / folders[0])
    import shutil

    shutil.copytree(tmp_path / "zone" / folders[1], tmp_path / "archive" / folders[1])
    moved = sinks.move_expired(spark, zone, archive, today, 30).collect()
    assert len(moved) == 8 and all(r.moved for r in moved)
    ids = lambda path: sorted(r.id for r in spark.read.parquet(path).collect())
    assert ids(zone) == list(range(9, 40)) and ids(archive) == list(range(9))
    assert sinks.move_expired(spark, zone, archive, today, 30).count() == 0
    # late rows of an archived day join it
    df.where("id = 4").write.mode("append").partitionBy("source", "year", "month", "day", "hour").parquet(zone)
    assert sinks.move_expired(spark, zone, archive, today, 30).count() == 1
    assert ids(archive) == sorted([*range(9), 4]) and not Path(f"{zone}/{folders[4]}").exists()


def test_alerts_are_appended_once(spark, tmp_path):
    def rows(ids, day):
        return spark.createDataFrame([(None, "k", 1.0, 1.0, 1.0, 1.0, "x", i, "app", "ERROR", T0 + timedelta(days=day), None, None) for i in ids], ALERT)

    path = f"{tmp_path}/alerts"
    assert sinks.append_alerts(rows(["a", "b", "b"], 0), path) == 2
    assert sinks.append_alerts(rows(["a", "b", "c"], 0), path) == 1
    assert sinks.append_alerts(rows(["a", "b", "c"], 0), path) == 0
    assert sinks.append_alerts(rows(["d"], 5), path) == 1
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == ["a", "b", "c", "d"]


def test_typed_merge_of_bodies(spark):
    cases = [
        ({"a": 1, "m": {"x": 1, "y": {"p": True}}, "log": '{"b": 2.5, "m": {"y": {"q": [1]}, "x": "t"}}'}, {"a": 1, "m": {"x": "t", "y": {"p": True, "q": [1]}}, "b": 2.5}),
        ({"a": None, "log": {"a": False}}, {"a": False}),
        ({"a": 1, "log": "plain text"}, {"a": 1, "log": "plain text"}),
        ({"a": 1, "log": "{broken"}, {"a": 1, "log": "{broken"}),
        ({"a": [1, {"b": 2}]}, {"a": [1, {"b": 2}]}),
    ]
    df = spark.createDataFrame([(i, json.dumps(c)) for i, (c, _) in enumerate(cases)] + [(9, "[1]"), (10, None)], "i int, r string")
    got = {r.i: r.m for r in df.select("i", F.to_json(D.merge_typed_body(F.col("r"))).alias("m")).collect()}
    assert [json.loads(got[i]) for i in range(len(cases))] == [w for _, w in cases]
    assert got[9] is None and got[10] is None
