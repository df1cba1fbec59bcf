"""Registered queries: traces, text weights, forests and evaluation."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.functions.expressions import has_error_word
from tidewatch.operators import evaluate as E
from tidewatch.operators import features as FE
from tidewatch.operators import forest, textweights, traces
from tidewatch.plans.features import DAY, HOUR, LOG_BASE_SQL, METRIC_BASE_SQL, samples
from tidewatch.plans.views import common_events, rounded, table
from tidewatch.schema import LOG_FEATURES, METRIC_FEATURES
from tidewatch.session import scratch_path, settle
from tidewatch.sources import sinks

SPAN_ORDER = ("ts", "l_linenumber", "l_partkey", "l_suppkey", "dur_ms")
# Longest order of the test data has 13 lines, so truncation (A30, T01b) is tested at 8; encoding and fit use the real limit.
CUT = 8


def spans(spark, sf):
    """Order lines as spans: service by return flag and part, operation by line status."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("trace_id"), F.expr("concat(l_returnflag, '-', l_suppkey % 5)").alias("service"),
        F.col("l_linestatus").alias("op"), F.col("l_extendedprice").alias("dur_ms"), F.expr("int(l_linenumber % 3)").alias("status"),
        F.col("l_shipdate").alias("ts"), "l_linenumber", "l_partkey", "l_suppkey")


SPANS_SQL = """sp AS (SELECT l_orderkey AS trace_id, l_returnflag || '-' || (l_suppkey % 5) AS service, l_linestatus AS op, l_extendedprice AS dur_ms,
    CAST(l_linenumber % 3 AS INT) AS status, l_shipdate AS ts, l_linenumber, l_partkey, l_suppkey FROM lineitem),
sv AS (SELECT service, CAST(dense_rank() OVER (ORDER BY service) - 1 AS INT) AS svc FROM (SELECT DISTINCT service FROM sp)),
ov AS (SELECT op, CAST(dense_rank() OVER (ORDER BY op) - 1 AS INT) AS op_id FROM (SELECT DISTINCT op FROM sp)),
rk AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY ts, l_linenumber, l_partkey, l_suppkey, dur_ms) AS pos, count(*) OVER (PARTITION BY trace_id) AS n
  FROM sp JOIN sv USING (service) JOIN ov USING (op)),
seq AS (SELECT * FROM rk WHERE pos <= 8 AND n >= 3)"""


def _vocab(spark, sf):
    s = spans(spark, sf)
    return traces.dense_ids(s, "service", "svc"), traces.dense_ids(s, "op", "op_id")


def _sequences(spark, sf):
    return traces.assemble(traces.with_ids(spans(spark, sf), *_vocab(spark, sf)), SPAN_ORDER, CUT)


def a29_vocabulary(spark, sf):
    svc, ops = _vocab(spark, sf)
    return svc.select(F.lit("service").alias("kind"), F.col("service").alias("name"), F.col("svc").alias("id")).unionByName(
        ops.select(F.lit("op").alias("kind"), F.col("op").alias("name"), F.col("op_id").alias("id")))


def a30_trace_sequences(spark, sf):
    s = _sequences(spark, sf).select("trace_id", F.explode("spans").alias("s"))
    return rounded(s.select("trace_id", "s.pos", "s.svc", "s.op_id", "s.dur_ms", "s.status"))


def j03_span_ids(spark, sf):
    s = traces.with_ids(spans(spark, sf), *_vocab(spark, sf))
    return s.groupBy("svc", "op_id").agg(F.count(F.lit(1)).alias("n"))


def t01b_sorted_truncated(spark, sf):
    s = _sequences(spark, sf)
    return rounded(s.select("trace_id", F.size("spans").alias("n"), F.col("spans")[0]["dur_ms"].alias("first_ms"), F.element_at("spans", -1)["dur_ms"].alias("last_ms")))


def sequences_and_sizes(spark, sf):
    svc, ops = _vocab(spark, sf)
    n_svc, n_ops = svc.count(), ops.count()  # vocabulary sizes fix the vector length
    return traces.assemble(traces.with_ids(spans(spark, sf), svc, ops), SPAN_ORDER, traces.MAX_SPANS), n_svc, n_ops


def _encoded(spark, sf):
    return traces.encode(*sequences_and_sizes(spark, sf), traces.MAX_SPANS)


def m09_trace_encoding(spark, sf):
    sequences, n_services, n_ops = sequences_and_sizes(spark, sf)
    e = traces.encode(sequences, n_services, n_ops, traces.MAX_SPANS).select("trace_id", F.posexplode(F.arrays_zip("x", "mask")).alias("pos", "c"))
    total = traces.cells_sum(F.col("c.x"), n_services + n_ops + 2)
    hot = F.array_position("c.x", F.lit(1.0).cast("double"))
    return rounded(e.select("trace_id", "pos", F.col("c.mask").alias("mask"), F.size("c.x").alias("dims"), total.alias("total"),
                            F.when(F.col("c.mask") > 0, hot).alias("service_at")))


def m10_trace_errors(spark, sf):
    sequences, n_services, n_ops = sequences_and_sizes(spark, sf)
    s = settle(traces.sparse_spans(sequences, n_services, n_ops).repartition(_tasks(spark)))
    model = traces.fit_sparse_autoencoder(s, n_services + n_ops + 2, 4)
    return rounded(traces.flag_above_percentile(traces.sparse_reconstruction_error(s, *model)))


def _texts(spark, sf):
    return table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("message"))


def _spread_texts(spark, sf):
    """The texts in at least one partition a task: a small table may sit in one, although cutting its words is heavy."""
    docs = _texts(spark, sf)
    return docs if docs.rdd.getNumPartitions() >= _tasks(spark) else docs.repartition(_tasks(spark))


def _vocabulary(docs):
    return textweights.vocabulary(textweights.gram_counts(docs, by_id=False), docs.agg(F.count(F.lit(1)).alias("n_docs")))


def _terms(spark, sf):
    """(stored terms of each document, vocabulary, numbers of the vocabulary)"""
    docs = _spread_texts(spark, sf)
    vocab = settle(_vocabulary(docs))
    numbered = settle(traces.dense_ids(vocab, "gram", "idx"))
    return textweights.document_terms(docs, numbered), vocab, numbered


def m07_text_vocabulary(spark, sf):
    return rounded(_vocabulary(_spread_texts(spark, sf)))


def m07_text_weights(spark, sf):
    w = textweights.sparse_weights(*_terms(spark, sf)).select("id", F.explode("values").alias("weight"))
    return rounded(w.groupBy("id").agg(F.count(F.lit(1)).alias("terms"), F.sum("weight").alias("total"), F.max("weight").alias("largest"),
                                       F.sum(F.col("weight") * F.col("weight")).alias("length")), 5)


TEXT_SQL = r"""w AS (SELECT doc_id AS id, w, count(*) AS c FROM (SELECT doc_id, unnest(regexp_split_to_array(lower(text), '[\s\x0B\x{85}\p{Z}]+')) AS w FROM documents) WHERE w <> '' GROUP BY ALL),
p AS (SELECT id, c, ' ' || w || ' ' AS p, length(w) + 2 AS len FROM w),
g AS (SELECT id, c, substr(p, CAST(i AS INT), CAST(n AS INT)) AS gram FROM (SELECT id, c, p, n, unnest(range(1, len - n + 2)) AS i FROM p CROSS JOIN (VALUES (2), (3), (4)) t(n) WHERE n <= len)),
tf AS (SELECT id, gram, sum(c) AS tf FROM g GROUP BY ALL),
vocab AS (SELECT gram, CAST(sum(tf) AS BIGINT) AS total, count(*) AS df FROM tf GROUP BY gram ORDER BY total DESC, gram LIMIT 10000),
v AS (SELECT *, ln((1 + (SELECT count(*) FROM documents)) / (1 + df)) + 1 AS idf FROM vocab),
raw AS (SELECT id, tf.gram, (1 + ln(tf)) * idf AS x FROM tf JOIN v ON v.gram = tf.gram),
wt AS (SELECT id, gram, x / sqrt(sum(x * x) OVER (PARTITION BY id)) AS weight FROM raw)"""


def _log_vectors(spark, sf):
    f = FE.log_window_features(common_events(spark, sf), HOUR)
    return settle(f.withColumn("key", F.concat_ws("|", "source", "host", F.unix_seconds("window_start").cast("string"))))


def _metric_vectors(spark, sf):
    f = FE.metric_window_features(samples(spark, sf), window=HOUR)
    return settle(f.withColumn("key", F.concat_ws("|", "host", "metric", F.unix_seconds("window_start").cast("string"))))


LOGS, METRICS = forest.dense(LOG_FEATURES), forest.dense(METRIC_FEATURES)


def _tasks(spark):
    """Scoring tasks for the small feature tables of the test data."""
    return spark.sparkContext.defaultParallelism


def _tree_shape(model, deepest):
    """Per tree: the sample at the root, the rows in its leaves, and whether it keeps within the depth limit."""
    leaf = F.col("dim") < 0
    return model.groupBy("tree").agg(
        F.max(F.when(F.col("node") == 0, F.col("mass"))).alias("sample"), F.sum(F.when(leaf, F.col("mass"))).alias("in_leaves"),
        (F.count_if(leaf) == F.count_if(~leaf) + 1).alias("binary"), (F.max("depth") <= deepest).alias("within_limit"))


def m02_isolation_fit(spark, sf):
    return _tree_shape(forest.fit_isolation_forest(_log_vectors(spark, sf), "key", LOGS), 8)


def m03_isolation_scores(spark, sf):
    x = _log_vectors(spark, sf)
    return rounded(forest.isolation_scores(x, "key", LOGS, forest.fit_isolation_forest(x, "key", LOGS), _tasks(spark)))


def m05_cut_fit(spark, sf):
    return _tree_shape(forest.fit_cut_forest(_metric_vectors(spark, sf), "key", METRICS), 10_000)


# A small model, given in numbers, so that the scores of the whole table can be stated in SQL as well.
FIXED_ISOLATION = ((0, 0, 1, 2, 0, 2.0, 16, 0), (0, 1, -1, -1, -1, 0.0, 10, 1), (0, 2, 3, 4, 1, 0.5, 6, 1), (0, 3, -1, -1, -1, 0.0, 2, 2),
                   (0, 4, -1, -1, -1, 0.0, 4, 2), (1, 0, 1, 2, 1, 0.25, 16, 0), (1, 1, -1, -1, -1, 0.0, 1, 1), (1, 2, -1, -1, -1, 0.0, 15, 1))
FIXED_CUT = ((0, 0, 1, 2, 0, 50.0, 8, 0, [0.0, 0.0], [100.0, 100.0]), (0, 1, -1, -1, -1, 0.0, 5, 1, [0.0, 10.0], [40.0, 90.0]),
             (0, 2, -1, -1, -1, 0.0, 3, 1, [60.0, 0.0], [100.0, 100.0]))


def _fixed_model(spark, nodes):
    return spark.createDataFrame([n if len(n) == 10 else (*n, None, None) for n in nodes], forest.NODES)


def m03_fixed_forest(spark, sf):
    shape = forest.dense(["request_count", "rate_5xx"])
    return rounded(forest.isolation_scores(_log_vectors(spark, sf), "key", shape, _fixed_model(spark, FIXED_ISOLATION), _tasks(spark)))


def m06_fixed_forest(spark, sf):
    shape = forest.dense(["value_p50", "value_max"])
    return rounded(forest.cut_scores(_metric_vectors(spark, sf), "key", shape, _fixed_model(spark, FIXED_CUT), _tasks(spark)))


def m08_fixed_forest(spark, sf):
    """The isolation model over the weights of the first two terms of the vocabulary, read from the sparse rows."""
    terms, vocab, numbered = _terms(spark, sf)
    nodes = [(*n[:5], n[5] / 100, *n[6:]) for n in FIXED_ISOLATION]

    def weigh(rows, then, schema):
        return textweights.sparse_weights(rows, vocab, numbered, then, schema)

    return rounded(forest.isolation_scores(terms, "id", forest.sparse(textweights.MAX_TERMS), _fixed_model(spark, nodes), vectors=weigh))


def m10_fixed_autoencoder(spark, sf):
    """Errors under a given mean (zero) and two given components: the first service and the seconds."""
    e = _encoded(spark, sf)
    dims = e.select(F.size(F.col("x")[0])).first()[0]
    components = np.zeros((dims, 2))
    components[0, 0] = components[dims - 2, 1] = 1.0
    return rounded(traces.reconstruction_error(e, np.zeros(dims), components))


def _gate_row(report, model, metric, value, n_train):
    gated = E.gate(report.select(F.lit(model).alias("model"), F.lit(metric).alias("metric"), F.col(value).alias("value"), "n_test"))
    return rounded(gated.withColumn("n_train", F.lit(n_train)))


def _parts(df, key, kind):
    s = settle(E.seeded_split(df, [key], kind))
    train = s.where("NOT is_test").drop("is_test")
    return train, s.where("is_test").drop("is_test"), train.count()


def m12_isolation_pipeline(spark, sf):
    """Split, fit on the train part, score the test part, evaluate that score against the z-score labels, gate."""
    train, test, n = _parts(_log_vectors(spark, sf), "key", "features")
    scores = forest.isolation_scores(test, "key", LOGS, forest.fit_isolation_forest(train, "key", LOGS), _tasks(spark))
    truth = E.flag_top(E.max_z(test, LOG_FEATURES), "z", 0.99, "truth").select("key", "truth")
    judged = E.flag_top(settle(scores.join(truth, "key")), "score", 0.99, "predicted")
    return _gate_row(E.classification_report(judged, "truth", "predicted"), "iforest-logs", "precision_at_top1pct", "precision", n)


def m11_cut_pipeline(spark, sf):
    train, test, n = _parts(_metric_vectors(spark, sf), "key", "features")
    scores = forest.cut_scores(test, "key", METRICS, forest.fit_cut_forest(train, "key", METRICS), _tasks(spark))
    truth = E.flag_top(E.max_z(test, METRIC_FEATURES), "z", 0.95, "truth").select("key", "truth")
    judged = settle(scores.join(truth, "key")).withColumn("predicted", F.col("score") >= forest.STRONG_CUT_SCORE)
    return _gate_row(E.classification_report(judged, "truth", "predicted"), "rcf-metrics", "f1", "f1", n)


def m13_text_pipeline(spark, sf):
    """Documents stand for log lines, low quality for anomalies."""
    terms, vocab, numbered = _terms(spark, sf)
    parts = E.seeded_split(terms, ["id"], "text")  # of a stored table, so only its ids are read to find the border
    n = parts.where("NOT is_test").count()
    train, test = (parts.where(which).drop("is_test") for which in ("NOT is_test", "is_test"))
    shape = forest.sparse(textweights.MAX_TERMS)

    def weigh(rows, then, schema):
        return textweights.sparse_weights(rows, vocab, numbered, then, schema)

    scores = forest.isolation_scores(test, "id", shape, forest.fit_isolation_forest(train, "id", shape, vectors=weigh), vectors=weigh)
    truth = table(spark, sf, "labels").select(F.col("doc_id").alias("id"), (F.col("quality") == 0).alias("truth"))
    judged = E.flag_top(settle(scores.join(truth, "id")), "score", 0.99, "predicted")
    return _gate_row(E.classification_report(judged, "truth", "predicted"), "log-embedding", "precision_at_top1pct", "precision", n)


def m10_trace_pipeline(spark, sf):
    """Traces with a slow span are the anomalies; the error of the test traces is judged by its area under the curve."""
    sequences, n_services, n_ops = sequences_and_sizes(spark, sf)
    train, test, n = _parts(sequences, "trace_id", "traces")
    model = traces.fit_sparse_autoencoder(settle(traces.sparse_spans(train, n_services, n_ops)), n_services + n_ops + 2, 4)
    errors = traces.sparse_reconstruction_error(traces.sparse_spans(test, n_services, n_ops), *model)
    truth = test.select("trace_id", F.exists("spans", lambda s: s["dur_ms"] > 60_000).alias("truth"))
    judged = settle(errors.join(truth, "trace_id"))
    report = E.auc(judged, "truth", "score").crossJoin(F.broadcast(judged.agg(F.count(F.lit(1)).alias("n_test"))))  # one row each
    return _gate_row(report, "trace-autoencoder", "auc", "auc", n)


def m06_cut_scores(spark, sf):
    x = _metric_vectors(spark, sf)
    s = forest.cut_scores(x, "key", METRICS, forest.fit_cut_forest(x, "key", METRICS), _tasks(spark))
    return rounded(s.withColumn("strong", F.col("score") > forest.STRONG_CUT_SCORE))


def m08_text_forest(spark, sf):
    terms, vocab, numbered = _terms(spark, sf)
    shape = forest.sparse(textweights.MAX_TERMS)

    def weigh(rows, then, schema):
        return textweights.sparse_weights(rows, vocab, numbered, then, schema)

    return rounded(forest.isolation_scores(terms, "id", shape, forest.fit_isolation_forest(terms, "id", shape, vectors=weigh), vectors=weigh))


def scored(spark, sf):
    """A score per event for the evaluation queries: its value, with error messages as truth."""
    e = common_events(spark, sf)
    return e.select("event_id", F.col("raw_value").alias("score"), has_error_word(F.col("message")).alias("truth"))


def m01_seeded_split(spark, sf):
    parts = []
    for kind, df, key in (
        ("features", FE.log_window_counts(common_events(spark, sf), DAY).withColumn("key", F.concat_ws("|", "source", "host", F.unix_seconds("window_start").cast("string"))), "key"),
        ("text", _texts(spark, sf), "id"),
        ("traces", spans(spark, sf).groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).where("n >= 3"), "trace_id"),
    ):
        s = E.seeded_split(df, [key], kind)
        parts.append(s.groupBy(F.lit(kind).alias("kind"), "is_test").agg(F.count(F.lit(1)).alias("n")))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def k08_split_files(spark, sf):
    path = scratch_path(spark, "split")
    f = FE.log_window_counts(common_events(spark, sf), DAY)
    s = settle(E.seeded_split(f, ["source", "host", "window_start"]))
    names = [c for c in f.columns if c in LOG_FEATURES]
    sinks.write_split(s.where("NOT is_test").select(*names), s.where("is_test").select(*names), path, "csv")
    count = lambda part: spark.read.schema(", ".join(f"{n} double" for n in names)).csv(f"{path}/{part}").agg(
        F.lit(part).alias("part"), F.count(F.lit(1)).alias("n"))
    return count("train").unionByName(count("test"))


def m04_serving_flags(spark, sf):
    return rounded(forest.serving_flags(scored(spark, sf).select("event_id", "score")))


def w06_top_percent(spark, sf):
    return rounded(E.flag_top(scored(spark, sf), "score", 0.99, "top").where("top").select("event_id", "score"))


def w08_max_z(spark, sf):
    x = FE.log_window_features(common_events(spark, sf), DAY)
    return rounded(E.max_z(settle(x), LOG_FEATURES).select("source", "host", "window_start", "z"))


def m11_cut_evaluation(spark, sf):
    x = settle(FE.metric_window_features(samples(spark, sf), window=HOUR))
    z = settle(E.flag_top(E.max_z(x, METRIC_FEATURES), "z", 0.95, "truth").withColumn("predicted", F.col("z") >= 3.0).select("z", "truth", "predicted"))
    report = E.classification_report(z, "truth", "predicted")
    return rounded(report.join(F.broadcast(E.auc(z, "truth", "z"))))  # one row each


def m12_isolation_evaluation(spark, sf):
    """Top one percent by p99 latency against the top one percent by combined z-score."""
    x = settle(FE.log_window_features(common_events(spark, sf), DAY))
    z = E.flag_top(E.max_z(x, LOG_FEATURES), "z", 0.99, "truth")
    z = E.flag_top(settle(z), "p99_latency_ms", 0.99, "predicted")
    return rounded(E.classification_report(z, "truth", "predicted").select("n_test", F.col("precision").alias("precision_at_top1pct"), F.col("recall").alias("recall_at_top1pct")))


def m13_text_evaluation(spark, sf):
    s = E.flag_top(scored(spark, sf), "score", 0.99, "predicted")
    r = E.classification_report(s, "truth", "predicted")
    return rounded(r.select("n_test", F.col("precision").alias("precision_at_top1pct"), F.col("anomaly_pct").alias("anomaly_rate")))


def m14_auc(spark, sf):
    """Text length against the toxicity label."""
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id")
    return rounded(E.auc(d.select((F.col("toxic") == 1).alias("truth"), F.col("n_chars").alias("score")), "truth", "score"))


def m15_gate(spark, sf):
    """Decisions on metrics measured from the event table."""
    s = scored(spark, sf)
    r = E.classification_report(E.flag_top(s, "score", 0.99, "predicted"), "truth", "predicted")
    a = E.auc(s, "truth", "score")
    m = r.select(F.inline(F.array(
        F.struct(F.lit("rcf-metrics").alias("model"), F.lit("f1").alias("metric"), F.col("f1").alias("value")),
        F.struct(F.lit("iforest-logs").alias("model"), F.lit("precision_at_top1pct").alias("metric"), (1 - F.col("anomaly_pct")).alias("value")),
        F.struct(F.lit("log-embedding").alias("model"), F.lit("precision_at_top1pct").alias("metric"), F.col("precision").alias("value")))))
    m = m.unionByName(a.select(F.lit("trace-autoencoder").alias("model"), F.lit("auc").alias("metric"), F.col("auc").alias("value")))
    return rounded(E.gate(m))


QUERIES = {
    "a29_vocabulary": a29_vocabulary, "a30_trace_sequences": a30_trace_sequences, "j03_span_ids": j03_span_ids, "t01b_sorted_truncated": t01b_sorted_truncated,
    "k08_split_files": k08_split_files, "m01_seeded_split": m01_seeded_split, "m02_isolation_fit": m02_isolation_fit, "m03_isolation_scores": m03_isolation_scores,
    "m04_serving_flags": m04_serving_flags, "m05_cut_fit": m05_cut_fit, "m06_cut_scores": m06_cut_scores, "m07_text_vocabulary": m07_text_vocabulary,
    "m07_text_weights": m07_text_weights, "m08_text_forest": m08_text_forest, "m09_trace_encoding": m09_trace_encoding, "m10_trace_errors": m10_trace_errors,
    "m11_cut_evaluation": m11_cut_evaluation, "m12_isolation_evaluation": m12_isolation_evaluation, "m13_text_evaluation": m13_text_evaluation,
    "m03_fixed_forest": m03_fixed_forest, "m06_fixed_forest": m06_fixed_forest, "m08_fixed_forest": m08_fixed_forest,
    "m10_fixed_autoencoder": m10_fixed_autoencoder, "m10_trace_pipeline": m10_trace_pipeline, "m11_cut_pipeline": m11_cut_pipeline,
    "m12_isolation_pipeline": m12_isolation_pipeline, "m13_text_pipeline": m13_text_pipeline, "m14_auc": m14_auc, "m15_gate": m15_gate, "w06_top_percent": w06_top_percent, "w08_max_z": w08_max_z,
}


def _z_sql(features, src):
    stats = ", ".join(f"avg({f}) AS m_{f}, stddev_pop({f}) + 1e-9 AS s_{f}" for f in features)
    z = ", ".join(f"abs(({f} - m_{f}) / s_{f})" for f in features)
    return f"st AS (SELECT {stats} FROM {src}), zz AS (SELECT {src}.*, greatest({z}) AS z FROM {src}, st)"


_AUC = "(sum(CASE WHEN truth THEN r END) - sum(CASE WHEN truth THEN 1 ELSE 0 END) * (sum(CASE WHEN truth THEN 1 ELSE 0 END) + 1) / 2.0) / (sum(CASE WHEN truth THEN 1 ELSE 0 END) * CAST(sum(CASE WHEN truth THEN 0 ELSE 1 END) AS DOUBLE))"
_MID = "(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS r"
SCORED_SQL = r"sc AS (SELECT event_id, value AS score, event_type = 'error' AS truth FROM events), fl AS (SELECT *, score >= (SELECT quantile_cont(score, 0.99) FROM sc) AS predicted FROM sc)"

def _c_sql(n):
    """Mean depth of a search among n points, as a number."""
    return repr(float(forest.average_path(np.array([n]))[0]))


def _isolation_sql(a, b, scale=1.0):
    leaf = lambda depth, mass: f"({depth} + {_c_sql(mass)})"
    first = f"CASE WHEN {a} <= {2.0 * scale} THEN {leaf(1, 10)} WHEN {b} <= {0.5 * scale} THEN {leaf(2, 2)} ELSE {leaf(2, 4)} END"
    second = f"CASE WHEN {b} <= {0.25 * scale} THEN {leaf(1, 1)} ELSE {leaf(1, 15)} END"
    return f"round(power(2.0, -(({first}) + ({second})) / (2 * {_c_sql(16)})), 6)"


_KEY_SQL = "concat_ws('|', {0}, CAST(epoch(window_start) AS BIGINT))"
_LOGS_HOUR_SQL = LOG_BASE_SQL.replace("1 day", "1 hour")
_OUT = "(greatest({v} - {hi}, 0) + greatest({lo} - {v}, 0))"


def _box_out(lo, hi):
    return " + ".join(_OUT.format(v=v, lo=l, hi=h) for v, l, h in zip(("value_p50", "value_max"), lo, hi))


def _cut_sql():
    """Score of the three-node model: cut off at the root with the share its box grows by, else judged at a leaf."""
    root, left, right = FIXED_CUT

    def leaf(node):
        equal = float((1 - node[6] / 16) / (1 + np.log2(node[6] + 1.0)))
        return f"CASE WHEN {_box_out(node[8], node[9])} > 0 THEN 0.5 ELSE {equal!r} END"

    out = _box_out(root[8], root[9])
    share = f"(({out}) / (({out}) + 200.0))"
    below = f"(CASE WHEN value_p50 <= 50.0 THEN {leaf(left)} ELSE {leaf(right)} END)"
    return f"round(({share} + (1 - {share}) * {below}) * log2(9.0), 6)"


def _shape_sql(src, trees, samples):
    return f"SELECT CAST(t AS INT) AS tree, least({samples}, n) AS sample, least({samples}, n) AS in_leaves, true AS \"binary\", true AS within_limit FROM (SELECT count(*) AS n FROM {src}), range(0, {trees}) r(t)"


ORACLES = {
    "m02_isolation_fit": f"{_LOGS_HOUR_SQL} {_shape_sql('feats', 200, 256)}",
    "m03_fixed_forest": f"{_LOGS_HOUR_SQL} SELECT {_KEY_SQL.format('source, host')} AS key, {_isolation_sql('request_count', 'rate_5xx')} AS score FROM feats",
    "m05_cut_fit": f"{METRIC_BASE_SQL} {_shape_sql('feats', 100, 512)}",
    "m06_fixed_forest": f"{METRIC_BASE_SQL} SELECT {_KEY_SQL.format('host, metric')} AS key, {_cut_sql()} AS score FROM feats",
    "m08_fixed_forest": f"""WITH {TEXT_SQL}, first AS (SELECT gram, row_number() OVER (ORDER BY gram) - 1 AS idx FROM vocab),
      x AS (SELECT id, coalesce(sum(weight) FILTER (idx = 0), 0) AS a, coalesce(sum(weight) FILTER (idx = 1), 0) AS b FROM wt JOIN first USING (gram) GROUP BY id)
      SELECT id, {_isolation_sql('a', 'b', 0.01)} AS score FROM x""",
    "m10_fixed_autoencoder": f"""WITH {SPANS_SQL}, d AS (SELECT (SELECT count(*) FROM sv) + (SELECT count(*) FROM ov) + 2 AS dims)
      SELECT trace_id, round(avg((CASE WHEN svc = 0 THEN 0 ELSE 1 END + 1 + status * status) / dims), 6) AS score FROM rk, d WHERE pos <= 64 AND n >= 3 GROUP BY trace_id""",
    "a29_vocabulary": f"WITH {SPANS_SQL} SELECT 'service' AS kind, service AS name, svc AS id FROM sv UNION ALL SELECT 'op', op, op_id FROM ov",
    "a30_trace_sequences": f"WITH {SPANS_SQL} SELECT trace_id, CAST(pos AS INT) AS pos, svc, op_id, round(dur_ms, 6) AS dur_ms, status FROM seq",
    "j03_span_ids": f"WITH {SPANS_SQL} SELECT svc, op_id, count(*) AS n FROM rk GROUP BY ALL",
    "t01b_sorted_truncated": f"WITH {SPANS_SQL} SELECT trace_id, CAST(max(pos) AS INT) AS n, round(min_by(dur_ms, pos), 6) AS first_ms, round(max_by(dur_ms, pos), 6) AS last_ms FROM seq GROUP BY trace_id",
    "k08_split_files": f"{LOG_BASE_SQL}, c AS (SELECT count(*) AS n, greatest(20, CAST(floor(count(*) * 0.2) AS BIGINT)) AS t FROM feats) SELECT 'train' AS part, n - t AS n FROM c UNION ALL SELECT 'test', t FROM c",
    "m01_seeded_split": f"""{LOG_BASE_SQL}, s AS (SELECT 'features' AS kind, count(*) AS n, 0.2 AS f, 20 AS least FROM feats UNION ALL SELECT 'text', count(*), 0.2, 50 FROM documents
      UNION ALL SELECT 'traces', count(*), 0.15, 10 FROM (SELECT l_orderkey FROM lineitem GROUP BY 1 HAVING count(*) >= 3)),
      t AS (SELECT kind, n, greatest(least, CAST(floor(n * f) AS BIGINT)) AS t FROM s) SELECT kind, true AS is_test, t AS n FROM t UNION ALL SELECT kind, false, n - t FROM t""",
    "m04_serving_flags": f"WITH {SCORED_SQL} SELECT event_id, score, predicted AS is_anomaly FROM fl",
    "m07_text_vocabulary": f"WITH {TEXT_SQL} SELECT gram, total, df, round(idf, 6) AS idf FROM v",
    "m07_text_weights": f"WITH {TEXT_SQL} SELECT id, count(*) AS terms, round(sum(weight), 5) AS total, round(max(weight), 5) AS largest, round(sum(weight * weight), 5) AS \"length\" FROM wt GROUP BY id",
    "m09_trace_encoding": f"""WITH {SPANS_SQL}, whole AS (SELECT * FROM rk WHERE pos <= 64 AND n >= 3), t AS (SELECT DISTINCT trace_id FROM whole), grid AS (SELECT trace_id, i AS pos FROM t CROSS JOIN range(0, 64) r(i))
      SELECT grid.trace_id, CAST(grid.pos AS INT) AS pos, CASE WHEN s.pos IS NULL THEN 0.0 ELSE 1.0 END AS mask,
        CAST((SELECT count(*) FROM sv) + (SELECT count(*) FROM ov) + 2 AS INT) AS dims,
        round(coalesce(2 + least(dur_ms / 1000, 60) + status, 0), 6) AS total, CASE WHEN s.pos IS NOT NULL THEN CAST(svc + 1 AS BIGINT) END AS service_at
      FROM grid LEFT JOIN whole s ON s.trace_id = grid.trace_id AND s.pos = grid.pos + 1""",
    "m11_cut_evaluation": f"""{METRIC_BASE_SQL}, {_z_sql(METRIC_FEATURES, 'feats')},
      l AS (SELECT z AS score, z >= (SELECT quantile_cont(z, 0.95) FROM zz) AS truth, z >= 3 AS predicted FROM zz), a AS (SELECT *, {_MID} FROM l)
      SELECT count(*) AS n_test, round(count(*) FILTER (truth AND predicted) / count(*) FILTER (predicted), 6) AS "precision", round(count(*) FILTER (truth AND predicted) / count(*) FILTER (truth), 6) AS recall,
        round(2 * count(*) FILTER (truth AND predicted) / (count(*) FILTER (truth) + count(*) FILTER (predicted)), 6) AS f1, round(count(*) FILTER (predicted) / count(*), 6) AS anomaly_pct, round({_AUC}, 6) AS auc FROM a""",
    "m12_isolation_evaluation": f"""{LOG_BASE_SQL}, {_z_sql(LOG_FEATURES, 'feats')},
      l AS (SELECT z >= (SELECT quantile_cont(z, 0.99) FROM zz) AS truth, p99_latency_ms >= (SELECT quantile_cont(p99_latency_ms, 0.99) FROM zz) AS predicted FROM zz)
      SELECT count(*) AS n_test, round(count(*) FILTER (truth AND predicted) / count(*) FILTER (predicted), 6) AS precision_at_top1pct, round(count(*) FILTER (truth AND predicted) / count(*) FILTER (truth), 6) AS recall_at_top1pct FROM l""",
    "m13_text_evaluation": f"WITH {SCORED_SQL} SELECT count(*) AS n_test, round(count(*) FILTER (truth AND predicted) / count(*) FILTER (predicted), 6) AS precision_at_top1pct, round(count(*) FILTER (predicted) / count(*), 6) AS anomaly_rate FROM fl",
    "m14_auc": f"WITH d AS (SELECT toxic = 1 AS truth, n_chars AS score FROM documents JOIN labels USING (doc_id)), a AS (SELECT *, {_MID} FROM d) SELECT round({_AUC}, 6) AS auc FROM a",
    "m15_gate": f"""WITH {SCORED_SQL}, a AS (SELECT *, {_MID} FROM sc),
      m AS (SELECT 'rcf-metrics' AS model, 'f1' AS metric, 2 * count(*) FILTER (truth AND predicted) / (count(*) FILTER (truth) + count(*) FILTER (predicted)) AS value, 0.70 AS threshold FROM fl
       UNION ALL SELECT 'iforest-logs', 'precision_at_top1pct', 1 - count(*) FILTER (predicted) / count(*), 0.80 FROM fl
       UNION ALL SELECT 'log-embedding', 'precision_at_top1pct', count(*) FILTER (truth AND predicted) / count(*) FILTER (predicted), 0.75 FROM fl
       UNION ALL SELECT 'trace-autoencoder', 'auc', {_AUC}, 0.80 FROM a)
      SELECT model, metric, round(value, 6) AS value, CAST(threshold AS DOUBLE) AS threshold, CASE WHEN value >= threshold THEN 'register' ELSE 'reject' END AS decision FROM m""",
    "w06_top_percent": f"WITH {SCORED_SQL} SELECT event_id, score FROM fl WHERE predicted",
    "w08_max_z": f"{LOG_BASE_SQL}, {_z_sql(LOG_FEATURES, 'feats')} SELECT source, host, window_start, round(z, 6) AS z FROM zz",
}
