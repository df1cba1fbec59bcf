"""Raw lines of fourteen sources to common events, as column expressions only.

``normalize(raw, source)`` takes a DataFrame with a string column ``value``
(one record each) and works on batches and streams alike.  A record that
cannot be an event keeps its text and gets a ``reason``; nothing is lost:
rows in = accepted + quarantined.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.schema import EVENT, MESSAGE_LIMIT

# Field order of the edge access log.
CLOUDFRONT_FIELDS = (
    "date", "time", "x_edge_location", "sc_bytes", "c_ip", "cs_method", "cs_host", "cs_uri_stem", "sc_status",
    "cs_referer", "cs_user_agent", "cs_uri_query", "cs_cookie", "x_edge_result_type", "x_edge_request_id",
    "x_host_header", "cs_protocol", "cs_bytes", "time_taken", "x_forwarded_for", "ssl_protocol", "ssl_cipher",
    "x_edge_response_result_type",
)
# Severities by firewall action, audit verb, document-store level and cache level.
WAF_SEVERITY = {"BLOCK": "ERROR", "COUNT": "WARN", "CHALLENGE": "WARN", "CAPTCHA": "WARN"}
EKS_SEVERITY = {
    "delete": "WARN", "deletecollection": "WARN", "patch": "INFO", "update": "INFO", "create": "INFO",
    "get": "DEBUG", "list": "DEBUG", "watch": "DEBUG",
}
MONGODB_SEVERITY = {"D1": "DEBUG", "D2": "DEBUG", "I": "INFO", "W": "WARN", "E": "ERROR", "F": "CRITICAL"}
REDIS_SEVERITY = {".": "DEBUG", "-": "INFO", "*": "INFO", "#": "WARN"}
# Span status codes by name.
OTEL_STATUS = {"STATUS_CODE_UNSET": "0", "STATUS_CODE_OK": "1", "STATUS_CODE_ERROR": "2"}
# Line patterns.
NGINX_LINE = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-) "([^"]*)" "([^"]*)"'
KAFKA_LINE = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2},\d{3})\] (DEBUG|INFO|WARN|ERROR|FATAL|TRACE) (.*?)(?: \(([\w.]+)\))?$"
REDIS_LINE = r"^(\d+):([A-Z]) (\d{1,2} \w{3} \d{4} \d{2}:\d{2}:\d{2}\.\d{3}) ([.\-*#])\s+(.*)$"
KEY_VALUE = r'(\w+)=("(?:[^"\\]|\\.)*"|\S+)'
MYSQL_USER = r"# User@Host: (\S+?)\[\S*?\] @ \S* \[(\S*)\]"
MYSQL_TIMES = r"# Query_time: ([\d.]+)\s+Lock_time: ([\d.]+)"
# Keys of an application record that become event columns.
APP_KEYS = (
    "ts", "timestamp", "@timestamp", "host", "hostname", "pod", "level", "severity", "status", "latency_ms",
    "src_ip", "client_ip", "user", "user_id", "path", "route", "message", "msg",
)
# Keys of a firewall record that are read.
WAF_KEYS = ("timestamp", "webaclId", "action", "terminatingRuleId", "rateBasedRuleList", "nonTerminatingMatchingRules", "httpRequest")
# Request headers that never leave the ingest job.
REDACTED_HEADERS = ("authorization", "cookie")


def _line() -> Column:
    return F.col("value")


def _lookup(key: Column, table: dict[str, str], default: str | None = None) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), F.lit(default).cast("string"))


def _iso(text: Column) -> Column:
    """A timestamp from ISO text; anything that does not start with a full date is no time."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), text.try_cast("timestamp"))


def _blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def _first_of(m: Column, *keys: str) -> Column:
    return F.coalesce(*[_blank_to_null(F.try_element_at(m, F.lit(k))) for k in keys])


def _number(text: Column, kind: str, absent: tuple[str, ...] = ("-",)) -> Column:
    return F.when(~text.isin(*absent), text.try_cast(kind))


def _bad_number(text: Column, kind: str, absent: tuple[str, ...] = ("-",)) -> Column:
    return ~text.isin(*absent) & text.try_cast(kind).isNull()


def _shown(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _from_json(ddl: str) -> Column:
    return F.from_json(_line(), f"{ddl}, _corrupt string", {"columnNameOfCorruptRecord": "_corrupt"})


def _json_problem(rec: Column, empty: Column) -> Column:
    return F.when(rec.isNull() | rec["_corrupt"].isNotNull(), "bad_json").when(empty, "empty_record")


def _any(*conds: Column) -> Column:
    out = F.lit(False)
    for c in conds:
        out = out | F.coalesce(c, F.lit(False))
    return out


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once per row, however often ``use`` names it or a lambda runs."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _last_map(entries: Column) -> Column:
    """A map of (key, value) entries; of repeated keys the last counts, whatever the session says about duplicates."""
    def build(named: Column) -> Column:
        lone = F.filter(named, lambda e, i: ~F.exists(F.slice(named, i + 2, F.size(named)), lambda later: later["key"] == e["key"]))
        # the comparison of all keys with all later ones is only for records that do repeat a key
        clear = F.size(F.array_distinct(named["key"])) == F.size(named)
        return F.when(clear, F.map_from_entries(named)).otherwise(F.map_from_entries(lone))

    return _once(F.filter(entries, lambda e: e["key"].isNotNull()), build)


def _alb(df: DataFrame) -> DataFrame:
    token = F.regexp_extract_all(F.trim(_line()), F.lit(r'"([^"]*)"|(\S+)'), F.lit(0))
    df = df.withColumn("_t", F.transform(token, lambda t: F.btrim(t, F.lit('"'))))
    df = df.withColumn("_p", F.when(F.size("_t") >= 14, F.col("_t")))
    p = [F.get("_p", F.lit(i)) for i in range(14)]
    times = [_number(p[i], "double", ("-", "-1")) for i in (5, 6, 7)]
    status = _number(p[8], "int")
    bad = _any(*[_bad_number(p[i], "double", ("-", "-1")) for i in (5, 6, 7)],
               *[_bad_number(p[i], "int") for i in (8, 9)], *[_bad_number(p[i], "bigint") for i in (10, 11)])
    words = F.split(p[12], " ", 3)
    method = words[0]
    path = F.when(F.size(words) == 3, F.get(words, F.lit(1))).otherwise("")
    unbalanced = (F.length(_line()) - F.length(F.replace(_line(), F.lit('"'), F.lit("")))) % 2 == 1
    zero = F.lit(0.0)
    latency = F.coalesce(times[0], zero) * 1000 + times[1] * 1000 + F.coalesce(times[2], zero) * 1000
    return df.select(
        "value",
        F.when(F.trim(_line()) == "", "empty_line").when(unbalanced, "bad_quoting").when(F.col("_p").isNull(), "too_few_fields")
        .when(bad, "bad_number").alias("reason"),
        p[1].alias("ts_raw"), _iso(p[1]).alias("ts"), p[2].alias("host"),
        F.when(status >= 500, "ERROR").alias("severity"), status.alias("status"), latency.alias("latency_ms"),
        _number(p[11], "bigint").alias("bytes"), F.split(p[3], ":")[0].alias("src_ip"), path.alias("path"),
        p[13].alias("user_agent"), F.concat(method, F.lit(" "), path, F.lit(" -> "), _shown(status)).alias("message"),
        F.to_json(F.struct(p[0].alias("type"), p[4].alias("target"), _number(p[10], "bigint").alias("received_bytes"),
                           _number(p[9], "int").alias("target_status"), status.alias("elb_status"))).alias("attrs"),
    )


def _cloudfront(df: DataFrame) -> DataFrame:
    df = df.withColumn("_f", F.split(F.regexp_replace(_line(), r"\n+$", ""), "\t"))
    f = {n: F.get("_f", F.lit(i)) for i, n in enumerate(CLOUDFRONT_FIELDS)}
    status = F.coalesce(f["sc_status"].try_cast("int"), F.lit(0))
    ts = F.concat(f["date"], F.lit("T"), f["time"], F.lit("Z"))
    return df.select(
        "value",
        F.when(_line() == "", "empty_line").when(_line().startswith("#"), "header").when(f["time"].isNull(), "too_few_fields").alias("reason"),
        ts.alias("ts_raw"), _iso(ts).alias("ts"), f["x_edge_location"].alias("host"),
        F.when(status >= 500, "ERROR").alias("severity"), status.alias("status"),
        (F.coalesce(f["time_taken"].try_cast("double"), F.lit(0.0)) * 1000).alias("latency_ms"),
        F.coalesce(f["sc_bytes"].try_cast("bigint"), F.lit(0)).alias("bytes"), f["c_ip"].alias("src_ip"),
        f["cs_uri_stem"].alias("path"), f["cs_user_agent"].alias("user_agent"),
        F.concat(F.coalesce(f["cs_method"], F.lit("?")), F.lit(" "), F.coalesce(f["cs_uri_stem"], F.lit("?")), F.lit(" -> "), _shown(status)).alias("message"),
        F.to_json(F.struct(f["x_edge_result_type"].alias("edge_result_type"), f["ssl_protocol"], f["x_forwarded_for"])).alias("attrs"),
    )


def redact_headers(headers: Column) -> Column:
    """Drop credentials from an array of (name, value) headers."""
    return F.filter(headers, lambda h: ~F.lower(h["name"]).isin(*REDACTED_HEADERS))


def _waf(df: DataFrame) -> DataFrame:
    df = df.withColumn("r", _from_json(
        "timestamp string, webaclId string, action string, terminatingRuleId string, rateBasedRuleList variant, "
        "nonTerminatingMatchingRules variant, httpRequest struct<clientIp: string, uri: string, httpMethod: string, "
        "country: string, headers: array<struct<name: string, value: string>>>"))
    r, h = F.col("r"), F.col("r.httpRequest")
    agents = F.filter(redact_headers(h["headers"]), lambda x: F.lower(x["name"]) == "user-agent")
    action = F.coalesce(_blank_to_null(r["action"]), r["terminatingRuleId"], F.lit(""))
    empty = F.coalesce(*[F.when(r[c].isNotNull(), False) for c in WAF_KEYS], F.lit(True))
    ts = r["timestamp"]
    # epoch seconds have ten digits until the year 2286, milliseconds thirteen
    number, digits = ts.try_cast("bigint"), F.length(ts)
    epoch = F.when(ts.rlike(r"^\d{10,16}$"), F.when(digits <= 10, F.timestamp_seconds(number)).when(digits <= 13, F.timestamp_millis(number))
                   .otherwise(F.timestamp_micros(number)))
    q = F.lit("?")
    return df.select(
        "value", _json_problem(r, empty).alias("reason"),
        ts.alias("ts_raw"), F.coalesce(epoch, _iso(ts)).alias("ts"), r["webaclId"].alias("host"),
        _lookup(action, WAF_SEVERITY).alias("severity"), h["clientIp"].alias("src_ip"), h["uri"].alias("path"),
        F.try_element_at(agents, F.lit(-1))["value"].alias("user_agent"),
        F.concat_ws(" ", action, F.coalesce(h["httpMethod"], q), F.coalesce(h["uri"], q)).alias("message"),
        F.to_json(F.struct(action.alias("action"), r["terminatingRuleId"].alias("terminating_rule"),
                           r["rateBasedRuleList"].alias("rate_based_rule_list"),
                           r["nonTerminatingMatchingRules"].alias("non_terminating_matching_rules"),
                           h["country"].alias("country"))).alias("attrs"),
    )


def _app(df: DataFrame) -> DataFrame:
    def unquote(x: Column) -> Column:
        return F.when(x.rlike(r'^".*"$') & (F.length(x) > 1), F.replace(x.substr(F.lit(2), F.length(x) - 2), F.lit('\\"'), F.lit('"'))).otherwise(x)

    pattern = F.lit(KEY_VALUE)
    entries = F.zip_with(F.regexp_extract_all(_line(), pattern, F.lit(1)), F.regexp_extract_all(_line(), pattern, F.lit(2)),
                         lambda k, v: F.struct(k.alias("key"), unquote(v).alias("value")))
    as_json = F.when(F.ltrim(_line()).startswith("{"), F.from_json(_line(), "map<string,string>"))
    df = df.withColumn("_j", as_json)
    is_json = F.coalesce(F.size("_j") > 0, F.lit(False))
    df = df.withColumn("_e", F.when(~is_json, entries))
    df = df.withColumn("_kv", _last_map(F.col("_e")))
    df = df.withColumn("m", F.when(is_json, F.col("_j")).when(F.size("_kv") > 0, F.col("_kv")).otherwise(F.create_map(F.lit("message"), _line())))
    m = F.col("m")
    at = lambda k: F.try_element_at(m, F.lit(k))
    ts = _first_of(m, "ts", "timestamp", "@timestamp")
    bad = F.map_contains_key(m, F.lit("latency_ms")) & at("latency_ms").try_cast("double").isNull()
    # the other keys keep their types: numbers, booleans and nested values of a JSON record stay what they are
    typed = _last_map(F.map_entries(F.from_json(_line(), "map<string,variant>")))
    rest = F.map_filter(F.when(is_json, typed).otherwise(F.transform_values(m, lambda _, v: v.cast("variant"))), lambda k, _: ~k.isin(*APP_KEYS))
    level = F.coalesce(at("level"), at("severity"))
    return df.select(
        "value", F.when(bad, "bad_number").alias("reason"), ts.alias("ts_raw"), _iso(ts).alias("ts"),
        _first_of(m, "host", "hostname", "pod").alias("host"), _blank_to_null(F.upper(level)).alias("severity"),
        F.when(at("status").rlike(r"^\d+$"), at("status").try_cast("int")).alias("status"),
        at("latency_ms").try_cast("double").alias("latency_ms"), _first_of(m, "src_ip", "client_ip").alias("src_ip"),
        _first_of(m, "user", "user_id").alias("user"), _first_of(m, "path", "route").alias("path"),
        F.coalesce(at("message"), at("msg"), F.to_json(m)).alias("message"), F.to_json(rest).alias("attrs"),
    )


def _eks(df: DataFrame) -> DataFrame:
    df = df.withColumn("r", _from_json(
        "kind string, verb string, auditID string, stage string, requestReceivedTimestamp string, stageTimestamp string, "
        "requestURI string, user struct<username: string>, sourceIPs array<string>, "
        "objectRef struct<apiGroup: string, resource: string, name: string, namespace: string>, "
        "responseStatus struct<code: int>, ts string, timestamp string, hostname string, level string, msg string, message string"))
    r = F.col("r")
    audit = (r["kind"] == "Event") & r["verb"].isNotNull()
    o, blank = r["objectRef"], F.lit("")
    user = F.coalesce(r["user"]["username"], blank)
    part = lambda c: F.coalesce(c, blank)
    path = F.regexp_replace(F.concat_ws("/", part(o["apiGroup"]), part(o["resource"]), part(o["name"])), "^/+|/+$", "")
    ts = F.when(audit, F.coalesce(r["requestReceivedTimestamp"], r["stageTimestamp"])).otherwise(F.coalesce(r["ts"], r["timestamp"]))
    text = F.concat(r["verb"], F.lit(" "), part(o["resource"]), F.lit(" by "), user)
    found = F.to_json(F.struct(
        r["verb"], r["stage"], r["responseStatus"]["code"].alias("response_status"), o["namespace"].alias("namespace"),
        o["resource"].alias("resource"), r["requestURI"].alias("request_uri")))
    return df.select(
        "value", _json_problem(r, F.trim(_line()).isin("{}", "null")).alias("reason"), ts.alias("ts_raw"), _iso(ts).alias("ts"),
        F.when(audit, r["auditID"]).otherwise(r["hostname"]).alias("host"),
        F.when(audit, _lookup(r["verb"], EKS_SEVERITY, "INFO")).otherwise(F.upper(F.coalesce(r["level"], F.lit("INFO")))).alias("severity"),
        F.when(audit, F.try_element_at(r["sourceIPs"], F.lit(1))).alias("src_ip"), F.when(audit, user).alias("user"),
        F.when(audit, path).alias("path"),
        F.when(audit, text).otherwise(F.coalesce(r["msg"], r["message"], blank)).alias("message"),
        F.when(audit, found).otherwise(_line()).alias("attrs"),
    )


def _groups(df: DataFrame, pattern: str, n: int) -> tuple[DataFrame, list[Column]]:
    """(frame with ``_hit``, the n groups of the first match, null without one); a line is matched once for all its groups."""
    line, cut = F.trim(_line()), "\0"
    joined = F.regexp_replace(line, pattern + r"[\s\S]*", cut.join(f"${i}" for i in range(1, n + 1)))
    one_by_one = F.array(*[F.regexp_extract(line, pattern, i) for i in range(1, n + 1)])
    df = df.withColumn("_hit", line.rlike(pattern))
    df = df.withColumn("_g", F.when(F.col("_hit"), F.when(line.contains(cut), one_by_one).otherwise(F.split(joined, cut))))
    return df, [F.get("_g", F.lit(i)) for i in range(n)]


def _nginx(df: DataFrame) -> DataFrame:
    df, (ip, user, ts, request, status, size, referer, agent) = _groups(df, NGINX_LINE, 8)
    words = F.split(request, " ", 3)
    known = F.size(words) >= 2
    method, path = F.when(known, words[0]).otherwise(""), F.when(known, F.get(words, F.lit(1))).otherwise("")
    code = status.try_cast("int")
    return df.select(
        "value", F.when(~F.col("_hit"), "no_match").alias("reason"), ts.alias("ts_raw"),
        F.try_to_timestamp(ts, F.lit("dd/MMM/yyyy:HH:mm:ss Z")).alias("ts"),
        F.when(code >= 500, "ERROR").when(code >= 400, "WARN").alias("severity"), code.alias("status"),
        size.try_cast("bigint").alias("bytes"), ip.alias("src_ip"), F.nullif(user, F.lit("-")).alias("user"),
        path.alias("path"), agent.alias("user_agent"),
        F.concat(method, F.lit(" "), path, F.lit(" -> "), status).alias("message"),
        F.to_json(F.struct(referer.alias("referer"))).alias("attrs"),
    )


def _kafka(df: DataFrame) -> DataFrame:
    df, (ts, level, msg, logger) = _groups(df, KAFKA_LINE, 4)
    iso = F.concat(F.replace(ts, F.lit(","), F.lit(".")), F.lit("Z"))
    return df.select(
        "value", F.when(~F.col("_hit"), "no_match").alias("reason"), iso.alias("ts_raw"), _iso(iso).alias("ts"),
        level.alias("severity"), msg.alias("message"), F.to_json(F.struct(_blank_to_null(logger).alias("logger"))).alias("attrs"),
    )


def _mysql(df: DataFrame) -> DataFrame:
    pick = lambda p, i: _blank_to_null(F.regexp_extract(_line(), p, i))
    ts, qt, lt = pick(r"# Time: (\S+)", 1), pick(MYSQL_TIMES, 1), pick(MYSQL_TIMES, 2)
    seconds = qt.try_cast("double")
    body = F.trim(F.regexp_replace(_line(), r"(?m)^#.*$", ""))
    df = df.withColumn("_body", F.regexp_replace(body, r"(?is)^\s*(use \S+;\s*)?(SET timestamp[^;]*;\s*)?", ""))
    body = F.col("_body")
    ended = body.rlike(r"(?s).;\s*$")
    sql = F.regexp_replace(F.regexp_replace(body, r";\s*$", ""), r"^\s+|\s+$", "")
    return df.select(
        "value", F.when(~_line().contains("# Time:"), "no_match").when(qt.isNotNull() & seconds.isNull(), "bad_number").alias("reason"),
        ts.alias("ts_raw"), _iso(ts).alias("ts"), F.when(seconds > 1.0, "WARN").otherwise("INFO").alias("severity"),
        (seconds * 1000).alias("latency_ms"), pick(MYSQL_USER, 2).alias("src_ip"), pick(MYSQL_USER, 1).alias("user"),
        F.when(ended, sql).otherwise(F.trim(_line())).alias("message"),
        F.to_json(F.struct(lt.try_cast("double").alias("lock_time"), _line().alias("block"))).alias("attrs"),
    )


def _mongodb(df: DataFrame) -> DataFrame:
    df = df.withColumn("r", _from_json("t struct<`$date`: string>, s string, c string, ctx string, id string, msg string, host string, attr variant"))
    r = F.col("r")
    ts = r["t"]["$date"]
    return df.select(
        "value", _json_problem(r, F.trim(_line()).isin("{}", "null")).alias("reason"), ts.alias("ts_raw"), _iso(ts).alias("ts"),
        r["host"].alias("host"), _lookup(r["s"], MONGODB_SEVERITY).alias("severity"),
        F.coalesce(r["msg"], F.lit("")).alias("message"),
        F.to_json(F.struct(r["c"].alias("component"), r["ctx"].alias("context"), r["id"].alias("id"), r["attr"].alias("attr"))).alias("attrs"),
    )


def _redis(df: DataFrame) -> DataFrame:
    df, (pid, role, ts, level, msg) = _groups(df, REDIS_LINE, 5)
    return df.select(
        "value", F.when(~F.col("_hit"), "no_match").alias("reason"), ts.alias("ts_raw"),
        F.try_to_timestamp(ts, F.lit("d MMM yyyy HH:mm:ss.SSS")).alias("ts"),
        _lookup(level, REDIS_SEVERITY, "INFO").alias("severity"), msg.alias("message"),
        F.to_json(F.struct(pid.alias("pid"), role.alias("role"))).alias("attrs"),
    )


def _metric(df: DataFrame) -> DataFrame:
    df = df.withColumn("r", _from_json("name string, labels map<string,string>, value string, ts string"))
    r = F.col("r")
    number = r["value"].try_cast("double")
    own = F.create_map(F.lit("metric"), r["name"].cast("variant"), F.lit("value"), number.cast("variant"))
    labels = F.coalesce(r["labels"], F.create_map().cast("map<string,string>"))
    typed = F.transform_values(labels, lambda _, v: v.cast("variant"))
    return df.select(
        "value", F.coalesce(_json_problem(r, F.trim(_line()).isin("{}", "null")), F.when(number.isNull(), "bad_number")).alias("reason"),
        r["ts"].alias("ts_raw"), _iso(r["ts"]).alias("ts"), _first_of(labels, "instance", "pod", "node").alias("host"),
        F.concat(r["name"], F.lit("="), number.cast("string")).alias("message"),
        F.to_json(F.map_concat(F.map_filter(own, lambda k, _: ~F.map_contains_key(labels, k)), typed)).alias("attrs"),
    )


def _otel_value(value: Column) -> Column:
    """A typed attribute value as a variant: a number, boolean, text, list or nested object, whatever the span says it is."""
    get = lambda path, kind: F.try_variant_get(value, path, kind)
    return F.coalesce(
        _blank_to_null(get("$.stringValue", "string")).cast("variant"),
        get("$.intValue", "string").try_cast("bigint").cast("variant"), get("$.doubleValue", "string").try_cast("double").cast("variant"),
        get("$.boolValue", "boolean").cast("variant"), get("$.arrayValue.values", "variant"), get("$.kvlistValue.values", "variant"))


def _otel(df: DataFrame) -> DataFrame:
    df = df.withColumn("r", _from_json(
        "traceId string, spanId string, parentSpanId string, name string, startTimeUnixNano string, endTimeUnixNano string, "
        "status struct<code: string>, attributes array<struct<key: string, value: variant>>"))
    r = F.col("r")
    entry = lambda a: F.struct(a["key"].alias("key"), _otel_value(a["value"]).alias("value"))
    df = df.withColumn("_e", F.transform(r["attributes"], entry)).withColumn("_typed", _last_map(F.col("_e")))
    code = F.coalesce(r["status"]["code"].try_cast("int"), _lookup(r["status"]["code"], OTEL_STATUS).cast("int"))
    nanos = {n: F.coalesce(r[c], F.lit("0")).try_cast("bigint") for n, c in (("_start", "startTimeUnixNano"), ("_end", "endTimeUnixNano"))}
    df = df.withColumns(nanos)
    start, end = F.col("_start"), F.col("_end")
    ms = (end - start) / F.lit(1e6)
    typed = lambda k: F.try_element_at("_typed", F.lit(k))
    at = lambda k: F.try_variant_get(typed(k), "$", "string")
    rest = F.map_filter("_typed", lambda k, v: v.isNotNull() & ~k.isin("service.name", "http.status_code"))
    return df.select(
        "value",
        F.coalesce(_json_problem(r, F.trim(_line()).isin("{}", "null")), F.when(start.isNull() | end.isNull(), "bad_number")).alias("reason"),
        r["startTimeUnixNano"].alias("ts_raw"), F.timestamp_micros(F.expr("_start div 1000")).alias("ts"),
        F.coalesce(_blank_to_null(at("host.name")), at("k8s.pod.name")).alias("host"),
        F.when(code == 2, "ERROR").otherwise("INFO").alias("severity"), ms.alias("latency_ms"),
        F.format_string("%s (%.1fms)", F.coalesce(r["name"], F.lit("?")), ms).alias("message"),
        F.to_json(F.struct(
            r["traceId"].alias("trace_id"), r["spanId"].alias("span_id"), r["parentSpanId"].alias("parent_span_id"),
            r["name"].alias("name"), typed("service.name").alias("service.name"), typed("http.status_code").alias("http.status_code"),
            code.alias("status_code"), F.when(F.size(rest) > 0, rest).alias("attributes"))).alias("attrs"),
    )


DIALECTS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "cloudfront": _cloudfront, "alb": _alb, "waf": _waf, "app": _app, "eks": _eks, "nginx": _nginx, "kafka": _kafka,
    "mysql": _mysql, "mongodb": _mongodb, "redis": _redis, "node-metrics": _metric, "container-metrics": _metric,
    "prometheus": _metric, "otel-traces": _otel,
}


def normalize(raw: DataFrame, source: str) -> DataFrame:
    """Event columns plus ``reason`` (null for an event) and the untouched ``value``."""
    parsed = DIALECTS[source](raw.select("value"))
    have = set(parsed.columns)
    reason = F.coalesce("reason", F.when(F.col("ts").isNull(), "bad_timestamp"))
    cols = []
    for f in EVENT.fields:
        if f.name == "source":
            c = F.lit(source)
        elif f.name == "ingest_ts":
            c = F.current_timestamp()
        elif f.name == "host":
            c = F.coalesce("host", F.lit("")) if "host" in have else F.lit("")
        elif f.name == "message":
            c = F.substring(F.coalesce("message", F.lit("")), 1, MESSAGE_LIMIT)
        elif f.name in have:
            c = F.col(f.name)
        else:
            c = F.lit(None)
        cols.append(c.cast(f.dataType).alias(f.name))
    out = parsed.select(*cols, reason.alias("reason"), "value")
    # One-element inline: a filter on the result is not pushed below the parser,
    # where it would repeat the parsing expressions for every reference.
    return out.select(F.inline(F.array(F.struct(*out.columns))))


def accepted(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNull()).drop("reason", "value")


def quarantined(normalized: DataFrame) -> DataFrame:
    return normalized.where(F.col("reason").isNotNull()).select("source", "reason", "value", "ingest_ts")


def normalize_all(raw_by_source: dict[str, DataFrame]) -> DataFrame:
    """One table of all sources; nothing but projections below the union."""
    out = None
    for source, raw in raw_by_source.items():
        part = normalize(raw, source)
        out = part if out is None else out.unionByName(part)
    return out


def with_metric_columns(events: DataFrame) -> DataFrame:
    """Lift the metric name and value out of ``attrs``."""
    return events.withColumns({
        "metric": F.get_json_object("attrs", "$.metric"),
        "metric_value": F.get_json_object("attrs", "$.value").try_cast("double"),
    })


def merge_log_body(record: Column, field: str = "log") -> Column:
    """Merge a JSON object held in ``field`` of a string map into the record and drop the field; all values become text.

    A body that is no JSON object stays where it is.  ``merge_typed_body`` keeps types.
    """
    body = F.try_element_at(record, F.lit(field))
    parsed = F.when(F.ltrim(body).startswith("{"), F.from_json(body, "map<string,string>"))
    rest = F.map_filter(record, lambda k, _: (k != field) & ~F.map_contains_key(parsed, k))
    return F.when(parsed.isNotNull(), F.map_concat(rest, parsed)).otherwise(record)


MERGE_DEPTH = 3


def _object(value: Column) -> Column:
    """A variant that holds an object, as a map of variants; null for anything else."""
    return F.when(F.schema_of_variant(value).startswith("OBJECT"), value.cast("map<string,variant>"))


def _merged(old: Column, new: Column, depth: int) -> Column:
    """Two maps of variants as one: keys of ``new`` win, and where both hold an object the two are merged in turn.

    Recursion ends at ``depth``: below it the new object takes the place of the old one.
    """
    def both(key: Column, value: Column) -> Column:
        other = F.try_element_at(new, key)
        if depth == 0:
            return F.when(F.map_contains_key(new, key), other).otherwise(value)

        def merge(pair: Column) -> Column:
            inner = F.parse_json(F.to_json(_merged(pair["ours"], pair["theirs"], depth - 1)))
            return F.when(pair["ours"].isNotNull() & pair["theirs"].isNotNull(), inner).otherwise(other)

        pair = F.struct(_object(value).alias("ours"), _object(other).alias("theirs"))
        return F.when(F.map_contains_key(new, key), _once(pair, merge)).otherwise(value)

    added = F.map_filter(new, lambda k, _: ~F.map_contains_key(old, k))
    return F.map_concat(F.transform_values(old, both), added)


def merge_typed_body(record: Column, field: str = "log", depth: int = MERGE_DEPTH) -> Column:
    """Merge the JSON object in ``field`` of a JSON record (a string) into it: the record as a map of variants.

    Numbers, booleans, nested objects and arrays keep their types; nested objects of both sides are merged key by key, down to
    ``depth``.  The body may be a JSON text or an object already.  A body that is neither stays where it is; a record that is no JSON object
    gives null.
    """
    def merge(top: Column) -> Column:
        held = F.try_element_at(top, F.lit(field))
        text = F.try_variant_get(held, "$", "string")
        body = F.coalesce(F.when(F.ltrim(text).startswith("{"), _object(F.try_parse_json(text))), _object(held))
        rest = F.map_filter(top, lambda k, _: k != field)
        parts = F.struct(top.alias("top"), rest.alias("rest"), body.alias("body"))
        return _once(parts, lambda p: F.when(p["body"].isNotNull(), _merged(p["rest"], p["body"], depth)).otherwise(p["top"]))

    parsed = _once(record, lambda r: F.when(F.ltrim(r).startswith("{"), F.from_json(r, "map<string,variant>")))
    return _once(parsed, merge)
