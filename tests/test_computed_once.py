"""Findings F7 to F12 of round 3: parsing, typed merges, span ids, encoding and the limiter do their work once."""

import random

import pytest
from pyspark.sql import functions as F

from tidewatch.operators import alerts as A
from tidewatch.operators import traces
from tidewatch.sources import dialects as D
from tidewatch.sources import readers, sinks


def _plan(df):
    return df._jdf.queryExecution().analyzed().toString()


def test_a_line_is_matched_once_for_all_its_groups(spark):
    good = '10.0.0.1 - u1 [01/Jan/2024:00:00:11 +0000] "GET /p/1 HTTP/1.1" 500 12 "-" "ua1" tail\nmore'
    odd = good.replace("ua1", "u\0a1")
    out = D.normalize(spark.createDataFrame([(good,), (odd,), ("x",)], "value string"), "nginx")
    rows = {r.value: r for r in out.collect()}
    for line, agent in ((good, "ua1"), (odd, "u\0a1")):
        r = rows[line]
        assert (r.src_ip, r.user, r.path, r.status, r.bytes, r.user_agent, r.message) == ("10.0.0.1", "u1", "/p/1", 500, 12, agent, "GET /p/1 -> 500")
    assert rows["x"].reason == "no_match"
    matched, _ = D._groups(spark.createDataFrame([("x",)], "value string"), D.NGINX_LINE, 8)
    assert "_g" in matched.columns


def test_kafka_line_without_logger_and_repeated_keys(spark):
    lines = [("[2024-01-01 00:00:11,172] INFO [Broker] event 1",), ("[2024-01-01 00:00:11,172] WARN a (x.y)",)]
    rows = D.normalize(spark.createDataFrame(lines, "value string"), "kafka").orderBy("severity").collect()
    assert [(r.severity, r.message, r.attrs) for r in rows] == [("INFO", "[Broker] event 1", "{}"), ("WARN", "a", '{"logger":"x.y"}')]
    m = spark.sql("SELECT array(named_struct('key', 'a', 'value', 1), named_struct('key', 'b', 'value', 2), named_struct('key', 'a', 'value', 3)) AS e")
    assert m.select(D._last_map(F.col("e")).alias("m")).first().m == {"a": 3, "b": 2}


def test_error_zone_is_read_by_its_schema(spark, tmp_path):
    rows = spark.createDataFrame([("app", "bad_number", "x"), ("app", "bad_number", "y"), ("waf", "bad_json", None)], "source string, reason string, value string")
    sinks.write_errors(rows.withColumn("ingest_ts", F.current_timestamp()), str(tmp_path / "zone"))
    zone = readers.read_errors(spark, str(tmp_path / "zone"))
    assert sorted((r.source, r.reason, r.value) for r in zone.collect() if r.value) == [("app", "bad_number", "x"), ("app", "bad_number", "y")]
    assert zone.count() == 3 and {"reason", "date", "ingest_ts"} <= set(zone.columns)


def test_typed_merge_parses_its_record_once(spark):
    rec = '{"a": {"b": {"c": {"d": {"e": 1, "f": 1}}}}, "n": null, "log": "{\\"a\\": {\\"b\\": {\\"c\\": {\\"d\\": {\\"e\\": 2}}}}, \\"n\\": 1.5, \\"z\\": [1]}"}'
    df = spark.createDataFrame([(rec,), ('{"log": "text"}',), ("[1]",), (None,)], "r string")
    out = df.select("r", D.merge_typed_body(F.col("r")).alias("m"))
    got = {r.r: r.j for r in out.select("r", F.to_json("m").alias("j")).collect()}
    # below the depth of three the new object takes the place of the old one
    assert got[rec] == '{"a":{"b":{"c":{"d":{"e":2}}}},"n":1.5,"z":[1]}'
    assert got['{"log": "text"}'] == '{"log":"text"}' and got["[1]"] is None and got[None] is None
    assert _plan(out).count("from_json(") == 1


def test_span_ids_do_not_move_the_spans(spark):
    spans = spark.range(1000).selectExpr("id AS trace_id", "concat('s', id % 3) AS service", "CASE WHEN id % 2 = 0 THEN 'x' END AS op")
    svc, ops = traces.dense_ids(spans, "service", "svc"), traces.dense_ids(spans, "op", "op_id")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = traces.with_ids(spans, svc, ops)
        assert "SortMergeJoin" not in out._jdf.queryExecution().sparkPlan().toString()
        assert {(r.svc, r.op_id): r["count"] for r in out.groupBy("svc", "op_id").count().collect()} == {
            (0, 0): 167, (0, 1): 167, (1, 0): 167, (1, 1): 166, (2, 0): 166, (2, 1): 167}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("dims", [6, traces.MAX_WRITTEN_OUT + 1])
def test_encoding_of_odd_ids_and_its_sums(spark, dims):
    rows = [(1, [(1, 0, 0, 500.0, 1), (2, 2, 1, 70000.0, 0), (3, None, 1, 0.0, 2), (4, 9, 0, 0.0, 0), (5, 2, None, 0.0, 0)])]
    kind = "trace_id int, spans array<struct<pos int, svc int, op_id int, dur_ms double, status int>>"
    e = traces.encode(spark.createDataFrame(rows, kind), 3, 2, 6)
    r = e.first()
    assert r.x == [[1, 0, 0, 1, 0, 0.5, 1], [0, 0, 1, 0, 1, 60, 0], [0, 0, 0, 0, 1, 0, 2], [0, 0, 0, 1, 0, 0, 0], [0, 0, 1, 0, 0, 0, 0], [0] * 7]
    assert r.mask == [1, 1, 1, 1, 1, 0]
    v = spark.range(1).select(F.array(*[F.lit(0.1 * i) for i in range(dims)]).alias("v"))
    total = 0.0
    for i in range(dims):
        total += 0.1 * i
    assert v.select(traces.cells_sum(F.col("v"), dims).alias("t")).first().t == total


def test_limiter_streams_its_blocks(spark, monkeypatch):
    from pyspark.sql import GroupedData

    monkeypatch.setattr(GroupedData, "applyInPandas", None)
    rng = random.Random(3)
    rows = sorted((f"k{rng.randrange(5)}", rng.randrange(400)) for _ in range(900))
    events = spark.createDataFrame([(k, s) for k, s in rows] + [(None, 5)], "user string, s long").withColumn("ts", F.timestamp_seconds("s"))
    got = {(r.user, r.second): (r.requests, r.admitted) for r in A.admitted_requests(events, "user", 4, 20, 30).collect()}
    want = {}
    for k, s in sorted(set(rows)):
        n = rows.count((k, s))
        want[k, s] = (n, min(n, 4 - sum(a for (k2, s2), (_, a) in want.items() if k2 == k and 0 < s - s2 <= 20)))
    assert got == want
    assert A.admitted_requests(events.where("user IS NULL"), "user", 4, 20, 30).count() == 0
