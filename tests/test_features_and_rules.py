import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import features as FE
from tidewatch.operators import rules as R
from tidewatch.schema import LOG_FEATURES, METRIC_FEATURES

EVENT = ("ts timestamp, source string, host string, severity string, status int, latency_ms double, bytes bigint, "
         "src_ip string, path string, user_agent string")
T0 = datetime(2024, 1, 1)


def at(seconds):
    return T0 + timedelta(seconds=seconds)


def test_normal_and_attack_windows(spark):
    rows = [(at(i), "app", "h", "INFO", 200, 50.0 + i, 1024, f"10.0.0.{i % 5}", "/x", "ua") for i in range(20)]
    rows += [(at(i), "waf", "h", "ERROR", 500, None, None, f"1.1.1.{i}", "/login", None) for i in range(10)]
    out = {r.source: r for r in FE.log_window_features(spark.createDataFrame(rows, EVENT)).collect()}
    a, w = out["app"], out["waf"]
    assert set(LOG_FEATURES) <= set(a.asDict())
    assert (a.request_count, a.rate_4xx, a.rate_5xx, a.distinct_ips, a.avg_bytes, a.entropy_path) == (20, 0, 0, 5, 1024, 0)
    assert a.p50_latency_ms == np.percentile([50 + i for i in range(20)], 50)
    assert a.entropy_src_ip == pytest.approx(math.log2(5))
    assert (w.rate_5xx, w.distinct_ips, w.auth_failure_rate, w.p99_latency_ms, w.avg_bytes, w.user_agent_distinct) == (1, 10, 1, 0, 0, 0)


def test_null_path_counts_blank_address_does_not(spark):
    rows = [(at(0), None, None, None, None, None, None, "", None, ""), (at(1), None, None, None, None, None, None, None, "", None)]
    r = FE.log_window_features(spark.createDataFrame(rows, EVENT)).first()
    assert (r.host, r.distinct_paths, r.distinct_ips, r.entropy_path, r.entropy_src_ip, r.user_agent_distinct) == ("", 1, 0, 0, 0, 0)


def test_hot_window_gives_the_same_features(spark):
    rng = np.random.default_rng(1)
    rows = [(at(int(i)), "app", "h" if i % 3 else "g", "INFO", 200, float(v), 1, "ip", "/p", "ua") for i, v in enumerate(rng.exponential(30, 250))]
    df = spark.createDataFrame(rows, EVENT)
    plain = FE.log_window_features(df).orderBy("host").collect()
    split = FE.log_window_features(df, hot_rows=20).orderBy("host").collect()
    assert [r.p99_latency_ms for r in split] == pytest.approx([r.p99_latency_ms for r in plain])


def test_eight_minutes_make_two_windows(spark):
    rows = [(at(60 * i), "app", "h", None, None, None, None, None, None, None) for i in range(8)]
    assert FE.log_window_features(spark.createDataFrame(rows, EVENT)).count() == 2


def test_metric_windows(spark):
    rows = [(at(i), "h", "cpu", str(i)) for i in range(10)] + [(at(300 + 10 * i), "h", "cpu", str(0.4)) for i in range(30)] + [(at(5), "h", "cpu", "bad")]
    out = FE.metric_window_features(spark.createDataFrame(rows, "ts timestamp, host string, metric string, value string")).orderBy("window_start").collect()
    first, second = out
    assert set(METRIC_FEATURES) <= set(first.asDict())
    assert (first.value_max, first.value_p50, first.delta_p50) == (9, 4.5, 0)
    assert first.slope == pytest.approx(1.0)
    assert second.delta_p50 == pytest.approx(0.4 - 4.5) and second.slope == pytest.approx(0.0, abs=1e-12)


def feed(rule, values):
    state = {}
    return [rule.update(state, v) for v in values]


def batch(spark, rules, values, block_rows=1_000_000, key="k"):
    rows = [(key, float(v), at(i), i) for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "metric_key string, value double, ts timestamp, event_id long")
    return R.apply_rules(df, rules, block_rows).orderBy("event_id", "rule_ord").collect()


def test_zscore_quiet_then_fires(spark):
    quiet = [100 + (i % 3) * 0.1 for i in range(200)]
    z = R.ZScore("z")
    assert not any(feed(z, quiet))
    hits = batch(spark, [z], quiet + [1000.0])
    assert [(h.event_id, h.detector) for h in hits] == [(200, "z")] and hits[0].score >= 1
    assert feed(z, quiet + [1000.0])[-1][1] == pytest.approx(hits[0].score)


def test_zscore_needs_eighteen_samples_to_reach_four():
    assert feed(R.ZScore("z"), [0.0] * 16 + [1.0])[-1] is None
    assert feed(R.ZScore("z"), [0.0] * 17 + [1.0])[-1] is not None


def test_ewma_shift_and_warmup(spark):
    rng = random.Random(42)
    calm = [1 + rng.uniform(-0.05, 0.05) for _ in range(60)]
    e = R.Ewma("ewma")
    assert any(feed(e, calm + [50.0] * 5)[60:])
    assert not any(feed(e, [1.0, 9.0] * 9 + [500.0]))  # the nineteenth sample
    assert feed(e, [1.0, 9.0] * 9 + [5.0, 500.0])[-1] is not None
    assert not any(feed(e, [2.0] * 40 + [9.0])[:40])
    hits = batch(spark, [e], calm + [50.0] * 5)
    assert 60 in [h.event_id for h in hits]


def test_blocks_do_not_change_any_rule(spark):
    rng = np.random.default_rng(5)
    values = np.abs(rng.normal(10, 3, 9000))
    values[rng.integers(0, 9000, 60)] *= 12
    values[4000:7000] = 3.0  # a long constant run
    rules = [R.ZScore("zscore"), R.Ewma("ewma"), R.RateOfChange("roc"), R.StaticThreshold("static", threshold=60.0)]
    whole = [(h.event_id, h.detector, h.baseline, h.score) for h in batch(spark, rules, values)]
    cut = [(h.event_id, h.detector, h.baseline, h.score) for h in batch(spark, rules, values, block_rows=2500)]
    assert [w[:2] for w in whole] == [c[:2] for c in cut] and len(whole) > 50
    assert np.allclose([w[2:] for w in whole], [c[2:] for c in cut])
    loop = [(i, r.name) for i, v in enumerate(values) for r in ()]
    states = [{} for _ in rules]
    for i, v in enumerate(values):
        for s, r in zip(states, rules):
            if r.update(s, float(v)):
                loop.append((i, r.name))
    assert loop == [w[:2] for w in whole]


def test_simple_rules(spark):
    assert feed(R.RateOfChange("r"), [1.0, 5.0])[1][1] == pytest.approx(2.0)
    assert feed(R.RateOfChange("r"), [0.0, 5.0, 1.0]) == [None, None, None]
    assert [bool(h) for h in feed(R.StaticThreshold("s"), [0.04, 0.10])] == [False, True]
    assert [bool(h) for h in feed(R.DistinctCount("d", threshold=1000), [500, 5000])] == [False, True]
    below = batch(spark, [R.StaticThreshold("low", threshold=1.0, direction="<")], [2.0, 0.5])
    assert [(h.event_id, h.score) for h in below] == [(1, 0.5)]


def test_default_set_and_key_filter(spark):
    assert [r.name for r in R.default_rules()] == ["zscore", "ewma", "rate-of-change", "error-rate-static", "ddos-distinct-ips"]
    only = [R.StaticThreshold("s", key_filter="latency"), R.DistinctCount("d", threshold=1)]
    assert [h.detector for h in batch(spark, only, [5.0], key="app:h:status_5xx")] == ["d"]


def test_metric_keys(spark):
    rows = [("node-metrics", "h", "cpu", 0.4, 5.0, 200), ("node-metrics", "", None, 0.4, None, None), ("app", None, None, None, 5.0, 200),
            ("app", "h", None, None, None, 503), ("app", "h", None, None, None, None)]
    e = spark.createDataFrame(rows, "source string, host string, metric string, metric_value double, latency_ms double, status int")
    e = e.withColumns({"ts": F.lit("2024-01-01").cast("timestamp"), "event_id": F.monotonically_increasing_id()})
    got = {(r.metric_key, r.value) for r in R.samples_from_events(e).collect()}
    assert got == {("node-metrics:h:cpu", 0.4), ("node-metrics:?:?", 0.4), ("app:?:latency_ms", 5.0), ("app:h:status_5xx", 1.0)}


def test_fusion_prefers_rules_then_models(spark):
    s = spark.createDataFrame([(1, "k", 1.0), (2, "k", 2.0), (3, "k", 3.0)], "event_id long, metric_key string, value double")
    a = spark.createDataFrame([(1, 2, "ewma", 0.5, 1.5), (1, 1, "zscore", 0.4, 1.2)], "event_id long, rule_ord int, detector string, baseline double, score double")
    m = spark.createDataFrame([(1, "rcf", 9.0, True), (2, "rcf", 4.0, True), (3, "rcf", -1.0, False)], "event_id long, model string, score double, is_anomaly boolean")
    got = {r.event_id: (r.is_anomaly, r.detector, r.score, r.baseline) for r in R.fuse_scores(s, a, m).collect()}
    assert got == {1: (True, "zscore", 9.0, 0.4), 2: (True, "rcf", 4.0, 2.0), 3: (False, "none", 0.0, 3.0)}
