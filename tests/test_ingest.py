import base64
import hashlib
import hmac
import json
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tidewatch.functions.keyed_hash import hmac_sha256, pseudonymise
from tidewatch.schema import EVENT, SOURCES
from tidewatch.sources import dialects as D
from tidewatch.sources import readers, sinks

ISO = "2024-05-06T07:08:09.123Z"
LINES = {
    "alb": f'h2 {ISO} app/web 192.0.2.7:5000 10.0.0.9:80 0.002 0.040 0.001 502 500 34 366 "GET /cart?id=1 HTTP/1.1" "curl/8" - - tail',
    "cloudfront": "2024-05-06\t07:08:09\tFRA2\t512\t192.0.2.7\tGET\thost\t/img.png\t404\t-\tagent\t-\t-\tMiss\trid\thh\thttps\t11\t0.250\t-\tTLSv1.3\tc\tMiss",
    "waf": json.dumps({"timestamp": 1714979289123, "webaclId": "acl", "action": "BLOCK",
                       "httpRequest": {"clientIp": "192.0.2.7", "uri": "/x", "httpMethod": "POST", "country": "DE",
                                       "headers": [{"name": "USER-Agent", "value": "sql"}, {"name": "Cookie", "value": "s"}]}}),
    "app": json.dumps({"ts": ISO, "level": "warn", "host": "web-1", "status": 401, "latency_ms": 12.5, "user": "u", "path": "/login", "message": "no", "tenant": 3}),
    "eks": json.dumps({"kind": "Event", "verb": "delete", "user": {"username": "root"}, "objectRef": {"resource": "pods", "namespace": "n", "name": "p"},
                       "sourceIPs": ["192.0.2.7", "10.1.1.1"], "stageTimestamp": ISO, "auditID": "a1", "responseStatus": {"code": 200}}),
    "nginx": '192.0.2.7 - bob [06/May/2024:09:08:09 +0200] "GET /a HTTP/1.1" 499 12 "ref" "agent"',
    "kafka": "[2024-05-06 07:08:09,123] FATAL [Broker 1] gone (kafka.server.Broker)",
    "mysql": f"# Time: {ISO}\n# User@Host: app[app] @ web [192.0.2.7]\n# Query_time: 1.500  Lock_time: 0.010\nSET timestamp=1714979289;\nSELECT *\nFROM t;",
    "mongodb": json.dumps({"t": {"$date": ISO}, "s": "F", "c": "NETWORK", "ctx": "c1", "msg": "down", "attr": {"a": {"b": 1}}}),
    "redis": "77:M 06 May 2024 07:08:09.123 # out of memory",
    "otel-traces": json.dumps({"traceId": "t", "spanId": "s", "name": "GET", "startTimeUnixNano": "1714979289123000000", "endTimeUnixNano": "1714979289173000000",
                               "status": {"code": 2}, "attributes": [{"key": "host.name", "value": {"stringValue": "h"}}, {"key": "http.status_code", "value": {"intValue": "500"}}]}),
}
for _s in ("node-metrics", "container-metrics", "prometheus"):
    LINES[_s] = json.dumps({"name": "cpu", "labels": {"instance": "i-1", "zone": "z"}, "value": 0.42, "ts": ISO})

EXPECT = {
    "alb": dict(host="app/web", severity="ERROR", status=502, latency_ms=43.0, bytes=366, src_ip="192.0.2.7", path="/cart?id=1", user_agent="curl/8", message="GET /cart?id=1 -> 502"),
    "cloudfront": dict(host="FRA2", severity=None, status=404, latency_ms=250.0, bytes=512, path="/img.png", user_agent="agent"),
    "waf": dict(host="acl", severity="ERROR", src_ip="192.0.2.7", user_agent="sql", path="/x", message="BLOCK POST /x"),
    "app": dict(host="web-1", severity="WARN", status=401, latency_ms=12.5, user="u", path="/login", message="no"),
    "eks": dict(host="a1", severity="WARN", user="root", src_ip="192.0.2.7", path="pods/p", message="delete pods by root"),
    "nginx": dict(host="", severity="WARN", status=499, bytes=12, src_ip="192.0.2.7", user="bob", path="/a", user_agent="agent"),
    "kafka": dict(severity="FATAL", message="[Broker 1] gone"),
    "mysql": dict(severity="WARN", latency_ms=1500.0, src_ip="192.0.2.7", user="app", message="SELECT *\nFROM t"),
    "mongodb": dict(severity="CRITICAL", message="down", host=""),
    "redis": dict(severity="WARN", message="out of memory"),
    "otel-traces": dict(host="h", severity="ERROR", latency_ms=50.0, message="GET (50.0ms)"),
    "node-metrics": dict(host="i-1", message="cpu=0.42"),
    "container-metrics": dict(host="i-1"),
    "prometheus": dict(host="i-1"),
}


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_every_source_gives_its_event(spark):
    assert set(LINES) == set(SOURCES)
    rows = D.normalize_all({s: lines(spark, LINES[s]) for s in SOURCES}).collect()
    assert len(rows) == 14
    for r in rows:
        assert r.reason is None, r
        d = r.asDict()
        assert set(EVENT.names) <= set(d) and d["ingest_ts"] is not None
        assert d["ts"].replace(microsecond=0) == datetime(2024, 5, 6, 7, 8, 9), r.source
        for k, v in EXPECT[r.source].items():
            assert d[k] == (pytest.approx(v) if isinstance(v, float) else v), (r.source, k)
        attrs = json.loads(d["attrs"])
        if r.source == "app":
            assert attrs == {"tenant": 3}
        if r.source == "mongodb":
            assert attrs["attr"] == {"a": {"b": 1}}
        if r.source.endswith("metrics"):
            assert attrs == {"metric": "cpu", "value": 0.42, "instance": "i-1", "zone": "z"}
        if r.source == "waf":
            assert attrs["country"] == "DE" and "Cookie" not in d["attrs"]


BROKEN = {
    "alb": ["", LINES["alb"][:40], LINES["alb"].replace("0.040", "fast"), LINES["alb"].replace('"curl/8"', '"curl')],
    "cloudfront": ["", "#Version: 1.0", "2024-05-06"],
    "waf": ["{", "", '{"action": "BLOCK"}'],
    "app": ["", '{"ts": "yesterday"}', '{"ts": "2024-05-06T07:08:09Z", "latency_ms": "slow"}'],
    "eks": ["{}", "null", "nope"],
    "nginx": ["", "GET /"],
    "kafka": ["[2024-05-06 07:08:09,123] LOUD x"],
    "mysql": ["SELECT 1;", "# Time: then\n# Query_time: 1.2.3  Lock_time: 0"],
    "mongodb": ["{}", '{"msg": "no time"}'],
    "redis": ["77:M 06 May 2024 07:08:09.123 ? x"],
    "node-metrics": ['{"name": "cpu", "value": "high", "ts": "2024-05-06T07:08:09Z"}'],
    "otel-traces": ['{"startTimeUnixNano": "soon"}', "[]x"],
}


@pytest.mark.parametrize("source", sorted(BROKEN))
def test_broken_lines_are_kept_aside(spark, source):
    raw = lines(spark, *BROKEN[source], LINES[source])
    n = D.normalize(raw, source)
    rows = n.collect()
    assert len(rows) == len(BROKEN[source]) + 1
    kept = {r.value for r in rows if r.reason}
    assert kept == set(BROKEN[source]), [(r.reason, r.value) for r in rows]
    assert D.accepted(n).count() + D.quarantined(n).count() == len(rows)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet='ab "{}[]:=\\-1#\t\u00e9\U0001f600', max_size=40), min_size=1, max_size=12))
def test_no_line_is_lost_or_fails_a_job(spark, junk):
    raw = lines(spark, *junk)
    n = D.normalize_all({s: raw for s in ("alb", "app", "waf", "nginx", "mysql", "otel-traces", "prometheus")})
    assert n.count() == 7 * len(junk) and len(n.select("reason", "value", "attrs", "message").collect()) == 7 * len(junk)


def test_app_key_value_and_plain_lines(spark):
    out = D.normalize(lines(spark, f'ts={ISO} level=error host=h msg="a \\"b\\" c" status=2x0 z=1 z=2', "plain words"), "app").collect()
    kv, plain = out
    assert (kv.severity, kv.message, kv.status, json.loads(kv.attrs)) == ("ERROR", 'a "b" c', None, {"z": "2"})
    assert plain.reason == "bad_timestamp" and plain.message == "plain words"


def test_long_messages_are_cut_to_the_limit(spark):
    r = D.normalize(lines(spark, json.dumps({"ts": ISO, "message": "é" * 5000})), "app").first()
    assert r.message == "é" * 4000


def test_keyed_hash(spark):
    df = spark.createDataFrame([("waf", "ann", "192.0.2.1"), ("app", "Zoë", None)], "source string, user string, src_ip string")
    for key in (b"k", b"x" * 100):
        want = hmac.new(key, "Zoë".encode(), hashlib.sha256).hexdigest()
        assert df.where("source = 'app'").select(hmac_sha256(F.col("user"), key)).first()[0] == want
    waf, app = pseudonymise(df, b"k").collect()
    assert waf.src_ip == "192.0.2.1" and waf.user == hmac.new(b"k", b"ann", hashlib.sha256).hexdigest() and app.src_ip is None


def test_delivery_batch(spark):
    good = base64.b64encode(b'{"a": 1}').decode()
    rows = [(1, good), (2, "%%%"), (3, base64.b64encode(b"{a").decode()), (4, None), (5, base64.b64encode(b"[1]").decode())]
    out = readers.decode_batch(spark.createDataFrame(rows, "id int, data string"), F.col("data"), "a int").orderBy("id").collect()
    assert [r.reason for r in out] == [None, "bad_base64", "bad_json", "no_data", "bad_json"] and out[0].event.a == 1


def test_readers(spark, tmp_path):
    (tmp_path / "in" / "deep").mkdir(parents=True)
    (tmp_path / "in" / "a.json").write_text('[\n {"k": 1},\n {"k": 2}\n]')
    (tmp_path / "in" / "deep" / "b.jsonl").write_text('{"k": 3}\n\n{"k": 4}\n')
    got = readers.read_records(spark, str(tmp_path / "in"), D.EVENT.__class__.fromDDL("k int"))
    assert sorted(r.k for r in got.where("k IS NOT NULL").collect()) == [1, 2, 3, 4]
    names = "value double, reason string, file string, at int, r int, text string, record string, _corrupt string"
    (tmp_path / "odd").mkdir()
    (tmp_path / "odd" / "a.json").write_text('[{"value": 1.5, "reason": "x", "_corrupt": "y"}, {"file": "f", "at": 3}]')
    (tmp_path / "odd" / "b.jsonl").write_text('{"value": 2.5, "text": "t", "record": "q"}\n{"r": 4}\nno object\n')
    odd = readers.record_lines(spark, str(tmp_path / "odd"), D.EVENT.__class__.fromDDL(names)).collect()
    assert sorted((r.reason, r.text) for r in odd if r.reason) == [("bad_json", "no object")]
    assert sorted((tuple(r.record) for r in odd if not r.reason), key=repr) == sorted([
        (1.5, "x", None, None, None, None, None, "y"), (None, None, "f", 3, None, None, None, None),
        (2.5, None, None, None, None, "t", "q", None), (None, None, None, None, 4, None, None, None)], key=repr)
    (tmp_path / "slow.log").write_text(LINES["mysql"] + "\n" + LINES["mysql"].replace("1.500", "0.2") + "\n")
    blocks = D.normalize(readers.read_mysql_blocks(spark, str(tmp_path / "slow.log")), "mysql")
    assert [(r.severity, r.message, r.reason) for r in blocks.collect()] == [("WARN", "SELECT *\nFROM t", None), ("INFO", "SELECT *\nFROM t", None)]
    (tmp_path / "log.jsonl").write_text('{"message": "  hi  "}\n{"message": " "}\nbroken\n{"x": 1}\n')
    assert [r.message for r in readers.read_log_lines(spark, str(tmp_path / "log.jsonl")).collect()] == ["hi"]


def test_raw_zone_round_trip_prunes_partitions(spark, tmp_path):
    events = D.accepted(D.normalize_all({s: lines(spark, LINES[s]) for s in ("alb", "app", "nginx")}))
    sinks.write_raw(events, str(tmp_path / "raw"))
    raw = readers.read_raw_zone(spark, str(tmp_path / "raw"))
    picked = raw.where("source = 'app' AND hour = 7")
    assert picked.count() == 1 and raw.count() == 3
    assert "PartitionFilters: [isnotnull(source" in picked._jdf.queryExecution().executedPlan().toString()
    kept = sinks.retention(events, "ts", F.lit("2024-08-10").cast("timestamp")).select("zone").distinct().collect()
    assert [r.zone for r in kept] == ["archive"]


def test_merge_log_body(spark):
    df = spark.createDataFrame([({"log": '{"level": "w", "a": {"b": 1}}', "level": "x"},), ({"log": "text"},), ({"log": "{broken"},)], "r map<string,string>")
    got = [r.r for r in df.select(D.merge_log_body(F.col("r")).alias("r")).collect()]
    assert got == [{"level": "w", "a": '{"b":1}'}, {"log": "text"}, {"log": "{broken"}]
