"""Inputs that once lost rows or broke a job."""

import json
from datetime import datetime

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators import alerts as A
from tidewatch.operators import drift, forest, traces
from tidewatch.operators import rules as R
from tidewatch.operators.skew import row_blocks
from tidewatch.session import ensure_checkpoint_dir
from tidewatch.sources import dialects as D
from tidewatch.sources import readers
from tidewatch.streaming import jobs


def parsed(spark, source, *lines):
    return D.normalize(spark.createDataFrame([(x,) for x in lines], "value string"), source).collect()


def test_a_bracket_line_does_not_turn_a_file_into_an_array(spark, tmp_path):
    (tmp_path / "lines.json").write_text('\n{"k":1}\n[oops\n{"k":2}\n17\n{"k":3}\n')
    (tmp_path / "an array.json").write_text('\n [\n  {"k": 4},\n  {\n   "k": 5\n  }\n]\n')
    schema = T.StructType([T.StructField("k", T.LongType())])
    assert sorted(r.k for r in readers.read_records(spark, str(tmp_path), schema).collect()) == [1, 2, 3, 4, 5]
    bad = readers.record_lines(spark, str(tmp_path), schema).where("reason is not null").collect()
    assert sorted(r.text for r in bad) == ["17", "[oops"]


def test_repeated_keys_count_once(spark):
    waf = {"timestamp": 1704067200, "webaclId": "w", "action": "BLOCK",
           "httpRequest": {"clientIp": "1.1.1.1", "uri": "/", "httpMethod": "GET",
                           "headers": [{"name": "User-Agent", "value": "a"}, {"name": "user-agent", "value": "b"}]}}
    span = {"traceId": "t", "spanId": "s", "name": "n", "startTimeUnixNano": "1704067200000000000", "endTimeUnixNano": "1704067200001000000",
            "status": {"code": "STATUS_CODE_ERROR"},
            "attributes": [{"key": "host.name", "value": {"stringValue": "x"}}, {"key": "host.name", "value": {"stringValue": "y"}}]}
    policy = spark.conf.get("spark.sql.mapKeyDedupPolicy")
    spark.conf.set("spark.sql.mapKeyDedupPolicy", "EXCEPTION")
    try:
        w, = parsed(spark, "waf", json.dumps(waf))
        o, = parsed(spark, "otel-traces", json.dumps(span))
        a, = parsed(spark, "app", "ts=2024-01-01T00:00:00Z level=info level=warn msg=x")
        m, = parsed(spark, "prometheus", json.dumps({"name": "up", "labels": {"metric": "m", "node": "h"}, "value": "1", "ts": "2024-01-01T00:00:00Z"}))
    finally:
        spark.conf.set("spark.sql.mapKeyDedupPolicy", policy)
    assert (w.reason, w.user_agent, w.ts) == (None, "b", datetime(2024, 1, 1))  # and epoch seconds are no milliseconds
    assert (o.reason, o.host, o.severity, json.loads(o.attrs)["status_code"]) == (None, "y", "ERROR", 2)
    assert (a.reason, a.severity) == (None, "WARN")
    assert (m.reason, json.loads(m.attrs)["metric"]) == (None, "m")


@pytest.mark.parametrize("stamp", ["1704067200", "1704067200000", "1704067200000000"])
def test_epochs_by_their_length(spark, stamp):
    r, = parsed(spark, "waf", json.dumps({"timestamp": stamp, "action": "ALLOW", "httpRequest": {"uri": "/"}}))
    assert r.ts == datetime(2024, 1, 1)


def test_long_lines_go_to_the_error_zone(spark, tmp_path):
    (tmp_path / "in").mkdir()
    ok = '{"ts": "2024-01-01T00:00:00Z", "message": "m"}'
    (tmp_path / "in/a.log").write_text("\n".join([ok, "x" * 500, ok]))
    jobs.ingest_stream(readers.stream_lines(spark, str(tmp_path / "in")), "app", str(tmp_path / "raw"), str(tmp_path / "err"),
                       str(tmp_path / "cp"), None, max_chars=100).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2
    bad, = spark.read.json(str(tmp_path / "err")).collect()
    assert (bad.reason, len(bad.value)) == ("too_long", 100)


def test_features_without_finite_values_stay_in_the_report(spark):
    ref = spark.createDataFrame([(float(i), None) for i in range(50)], "a double, b double").withColumn("b", F.lit(float("inf")))
    base = drift.reference_histogram(ref, ["a", "b"])
    report = {r.feature: r for r in drift.drift_report(ref, base).collect()}
    assert set(report) == {"a", "b"}
    assert (report["b"].psi, report["b"].kl_divergence) == (0.0, 0.0)


def test_spans_without_names_keep_their_place(spark):
    rows = [("t", None if i == 1 else "s", None if i == 2 else "o", 1.0, 0, i) for i in range(4)]
    spans = spark.createDataFrame(rows, "trace_id string, service string, op string, dur_ms double, status int, ts int")
    ids = traces.with_ids(spans, traces.dense_ids(spans, "service", "svc"), traces.dense_ids(spans, "op", "op_id"))
    assert [len(r.spans) for r in traces.assemble(ids, ["ts"]).collect()] == [4]


def test_two_events_at_one_instant_are_two_alerts(spark):
    at = datetime(2024, 1, 1)
    s = spark.createDataFrame([("k", 1.0, at, 1), ("k", 2.0, at, 2)], "metric_key string, value double, ts timestamp, event_id long")
    found = A.to_alerts(R.apply_rules(s, [R.StaticThreshold("limit")]), F.lit(at))
    assert found.select("id").distinct().count() == 2


def test_a_failing_fold_leaves_the_others_alone(spark):
    class Throwing(R.Ewma):
        def fold(self, values):
            raise ValueError("no")

    rng = np.random.default_rng(1)
    values = rng.normal(0, 1, 400)
    values[::50] += 30
    rows = [("k", float(v), datetime(2024, 1, 1, 0, i // 60, i % 60), i) for i, v in enumerate(values)]
    s = spark.createDataFrame(rows, "metric_key string, value double, ts timestamp, event_id long")
    both = R.apply_rules(s, [Throwing("bad"), R.Ewma("good")]).collect()
    alone = R.apply_rules(s, [R.Ewma("good")]).collect()
    assert {r.detector for r in both} == {"good"} and len(both) == len(alone) > 0
    # one wording in batches and on streams
    state, rule = {}, R.Ewma("good")
    texts = [rule.say(v, *hit) for v in values.tolist() for hit in [rule.update(state, v)] if hit]
    assert [r.explanation for r in sorted(alone, key=lambda r: r.event_id)] == texts


def test_vectorised_fold_equals_the_recurrence():
    rule, rng = R.Ewma("e"), np.random.default_rng(2)
    values = pd.Series(rng.normal(5, 2, 3000) + np.where(rng.random(3000) < 0.02, 40, 0), index=range(7, 3007))
    state = {}
    want = [rule.update(state, v) for v in values.tolist()]
    got = rule.fold(values)
    assert [(None if h is None else round(h[1], 9)) for h in want] == [None if np.isnan(x) else round(x, 9) for x in got["score"]]
    assert len(rule.fold(pd.Series([], dtype=float))) == 0


def test_every_tree_draws_from_all_rows(spark):
    rows = spark.range(40_000).select(F.concat(F.lit("k"), "id").alias("key"), F.col("id").cast("double").alias("x"))
    picked = forest.tree_samples(rows, "key", forest.dense(["x"]), trees=50, samples=64, seed=1)
    per = {r.tree: r.n for r in picked.groupBy("tree").agg(F.count("*").alias("n")).collect()}
    assert set(per) == set(range(50)) and min(per.values()) >= 64 and max(per.values()) < 160
    # 50 trees of some 96 rows over 40,000 rows hardly ever meet in a row
    assert picked.select("key").distinct().count() > 4000
    model = forest.fit_isolation_forest(rows, "key", forest.dense(["x"]), trees=50, samples=64)
    assert {r.mass for r in model.where("node = 0").collect()} == {64}


def test_long_hot_lists_are_joined_by_key(spark, monkeypatch):
    from tidewatch.operators import skew

    monkeypatch.setattr(skew, "MAX_BROADCAST_KEYS", 2)
    df = spark.range(4000).select((F.col("id") % 7).alias("key"), F.timestamp_seconds("id").alias("ts"), "id")
    out = row_blocks(df, ["key"], "ts", ["ts", "id"], halo=3, block_rows=100)
    assert out.where("not _halo").count() == 4000
    assert out.groupBy("key", "_block").count().agg(F.max("count")).first()[0] <= 103


def test_limiter_and_cooldown_by_runs(spark):
    rng = np.random.default_rng(3)
    seconds = np.cumsum(rng.choice([1, 2, 5, 200], 500, p=[0.5, 0.3, 0.15, 0.05]))
    e = spark.createDataFrame([("u", datetime.fromtimestamp(int(s))) for s in seconds], "user string, ts timestamp")
    got = A.admitted_requests(e, "user", 3, 60).orderBy("second").collect()
    used, want = [], []
    for s in seconds.tolist():
        ok = sum(1 for t in used if s - t <= 60) < 3
        used += [s] if ok else []
        want.append(int(ok))
    assert [r.admitted for r in got] == want
    alerts = spark.createDataFrame([("k", datetime.fromtimestamp(int(s)), f"{i:04}") for i, s in enumerate(seconds)], "metric_key string, created_at timestamp, id string")
    last, keep = None, []
    for i, s in enumerate(seconds.tolist()):
        if last is None or s - last > 120:
            keep, last = [*keep, f"{i:04}"], s
    assert sorted(r.id for r in A.with_cooldown(alerts, 2).collect()) == keep


def test_a_cluster_without_shared_folder_is_told(monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()

        class conf:
            @staticmethod
            def get(key, default=None):
                return default

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(Session())


def test_attributes_keep_their_types(spark):
    a, kv = parsed(spark, "app", '{"ts":"2024-01-01T00:00:00Z","tenant":3,"ok":true,"nest":{"a":[1,2.5]},"tenant":4}', "ts=2024-01-01T00:00:00Z msg=x tenant=3")
    assert json.loads(a.attrs) == {"tenant": 4, "ok": True, "nest": {"a": [1, 2.5]}}
    assert json.loads(kv.attrs) == {"tenant": "3"}
    m, = parsed(spark, "node-metrics", json.dumps({"name": "cpu", "labels": {"instance": "h"}, "value": 0.42, "ts": "2024-01-01T00:00:00Z"}))
    assert json.loads(m.attrs) == {"metric": "cpu", "value": 0.42, "instance": "h"}
    d, = parsed(spark, "mongodb", '{"t":{"$date":"2024-01-01T00:00:00Z"},"s":"I","c":"C","msg":"m","attr":{"n":1,"ok":false}}')
    assert json.loads(d.attrs)["attr"] == {"n": 1, "ok": False}
    w, = parsed(spark, "waf", '{"timestamp":"1704067200000","action":"ALLOW","rateBasedRuleList":[{"limit":5}],"httpRequest":{"uri":"/"}}')
    assert json.loads(w.attrs)["rate_based_rule_list"] == [{"limit": 5}]
