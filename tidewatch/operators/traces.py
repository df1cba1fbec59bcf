"""Traces: vocabularies, sequence assembly, encoding and reconstruction error."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.quantiles import exact_percentiles
from tidewatch.operators.skew import MAX_BROADCAST_KEYS
from tidewatch.session import settle

# Longest and shortest sequence, duration cap (seconds) and error percentile.
MAX_SPANS, MIN_SPANS, MAX_SECONDS, ERROR_PERCENTILE = 64, 3, 60.0, 0.95
UNKNOWN = "unknown"
# Sums over vectors of up to so many dimensions are written out as one expression.
MAX_WRITTEN_OUT = 100


def dense_ids(names: DataFrame, column: str, id_column: str) -> DataFrame:
    """Distinct names with ids 0, 1, 2, ... in name order; a missing name counts as ``UNKNOWN``.

    The distributed sort numbers the rows inside its partitions; adding the
    sizes of the partitions before gives the id, so no task sees all names.
    """
    distinct = names.select(F.coalesce(column, F.lit(UNKNOWN)).alias(column)).distinct()
    ordered = settle(distinct.orderBy(column).withColumn("_m", F.monotonically_increasing_id()))
    part = F.shiftright("_m", 33)
    sizes = ordered.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"))
    inside = F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))
    out = ordered.withColumn("_part", part).join(F.broadcast(offsets), "_part")
    return out.select(column, (F.col("_offset") + inside).cast("int").alias(id_column))


def with_ids(spans: DataFrame, services: DataFrame, ops: DataFrame) -> DataFrame:
    """Look up the service and operation ids; vocabularies of up to ``MAX_BROADCAST_KEYS`` names are counted and broadcast.

    Spark judges a vocabulary by the size of the spans that it was taken from, and would move and sort all spans by their few names.
    A span without service or operation keeps its place in the trace under the name ``UNKNOWN``.
    """
    named = spans.withColumns({c: F.coalesce(c, F.lit(UNKNOWN)) for c in ("service", "op")})
    for ids, name in ((services, "service"), (ops, "op")):
        few = ids.limit(MAX_BROADCAST_KEYS + 1).count() <= MAX_BROADCAST_KEYS
        named = named.join(F.broadcast(ids) if few else ids, name)
    return named


def assemble(spans: DataFrame, order: Sequence[str], max_spans: int = MAX_SPANS, min_spans: int = MIN_SPANS) -> DataFrame:
    """(trace_id, spans) with the first ``max_spans`` spans in order; short traces are left out.

    ``spans`` needs trace_id, svc, op_id, dur_ms, status and the order columns.
    The rank filter is applied before the shuffle too, so a runaway trace
    ships at most ``max_spans`` rows per task.
    """
    w = Window.partitionBy("trace_id").orderBy(*order)
    first = spans.withColumn("pos", F.row_number().over(w)).where(F.col("pos") <= max_spans)
    row = F.struct("pos", "svc", "op_id", F.coalesce("dur_ms", F.lit(0.0)).alias("dur_ms"), F.coalesce("status", F.lit(0)).alias("status"))
    out = first.groupBy("trace_id").agg(F.sort_array(F.collect_list(row)).alias("spans"))
    return out.where(F.size("spans") >= min_spans)


def encode(sequences: DataFrame, n_services: int, n_ops: int, max_spans: int = MAX_SPANS) -> DataFrame:
    """Add ``x`` (padded spans of one-hot service, one-hot operation, capped seconds, status) and ``mask``."""
    dims = n_services + n_ops + 2

    def vector(s):
        zeros = lambda n: F.array_repeat(F.lit(0.0), n)
        one = F.array(F.lit(1.0))
        runs = F.concat(zeros(s["svc"]), one, zeros(n_services - 1 - s["svc"] + s["op_id"]), one, zeros(n_ops - 1 - s["op_id"]))
        # an id that is missing or outside its vocabulary sets no dimension of its own
        cells = F.transform(F.sequence(F.lit(0), F.lit(n_services + n_ops - 1)),
                            lambda i: F.when((i == s["svc"]) | (i == s["op_id"] + n_services), 1.0).otherwise(0.0))
        known = s["svc"].between(0, n_services - 1) & s["op_id"].between(0, n_ops - 1)
        hot = F.when(known, runs).otherwise(cells)
        return F.concat(hot, F.array(F.least(s["dur_ms"] / 1000, F.lit(MAX_SECONDS)), s["status"].cast("double")))

    pad = F.array_repeat(F.array_repeat(F.lit(0.0), dims), F.lit(max_spans) - F.size("spans"))
    mask = F.concat(F.array_repeat(F.lit(1.0), F.size("spans")), F.array_repeat(F.lit(0.0), F.lit(max_spans) - F.size("spans")))
    return sequences.withColumns({"x": F.concat(F.transform("spans", vector), pad), "mask": mask})


def cells_sum(x: Column, dims: int) -> Column:
    """Sum of the ``dims`` cells of a vector, first to last; short ones are written out, which spares a lambda call per cell."""
    if dims > MAX_WRITTEN_OUT:
        return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    return reduce(lambda a, i: a + F.get(x, F.lit(i)), range(dims), F.lit(0.0))


def fit_autoencoder(encoded: DataFrame, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of a linear autoencoder over all real spans; only d and d*k numbers return."""
    spans = encoded.select(F.explode(F.arrays_zip("x", "mask")).alias("s")).where(F.col("s.mask") > 0).select("s.x")
    model = PCA(k=k, inputCol="v", outputCol="z").fit(spans.select(array_to_vector("x").alias("v")))
    components = model.pc.toArray()
    dims = components.shape[0]
    mean = spans.agg(F.array(*[F.avg(F.col("x")[i]) for i in range(dims)]).alias("m")).first().m
    return np.array(mean), components


def reconstruction_error(encoded: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """(trace_id, score): squared error averaged over dimensions, then over the real spans."""
    project = components @ components.T

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            scores = []
            for x, mask in zip(pdf["x"], pdf["mask"]):
                real = np.stack(x)[np.asarray(mask) > 0] - mean
                scores.append(float((((real @ project) - real) ** 2).mean(axis=1).mean()))
            yield pd.DataFrame({"trace_id": pdf["trace_id"], "score": scores})

    kind = encoded.schema["trace_id"].dataType.simpleString()
    return encoded.select("trace_id", "x", "mask").mapInPandas(run, f"trace_id {kind}, score double")


def sparse_spans(sequences: DataFrame, n_services: int, n_ops: int) -> DataFrame:
    """(trace_id, hot, seconds, status): per span the two dimensions that are one, and the two measured values.

    The same vectors as ``encode`` makes, of n_services + n_ops + 2 dimensions, without their zeros and without padding.
    """
    hot = F.transform("spans", lambda s: F.array(s["svc"], s["op_id"] + n_services))
    return sequences.select("trace_id", F.flatten(hot).alias("hot"),
                            F.transform("spans", lambda s: F.least(s["dur_ms"] / 1000, F.lit(MAX_SECONDS))).alias("seconds"),
                            F.transform("spans", lambda s: s["status"].cast("double")).alias("status"))


def _flat(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hot dimensions, two a span; measured values, two a span; spans of each trace)."""
    lengths = pdf["seconds"].map(len).to_numpy(np.int64)
    if not len(lengths) or not lengths.sum():
        return np.zeros((0, 2), np.int64), np.zeros((0, 2)), lengths
    measured = np.stack([np.concatenate(pdf["seconds"].to_list()), np.concatenate(pdf["status"].to_list())], axis=1)
    return np.concatenate(pdf["hot"].to_list()).reshape(-1, 2).astype(np.int64), measured, lengths


def _times(hot: np.ndarray, measured: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """Sparse spans times a dense matrix of few columns."""
    return matrix[hot[:, 0]] + matrix[hot[:, 1]] + measured @ matrix[-2:]


def fit_sparse_autoencoder(spans: DataFrame, dims: int, k: int, seed: int = 42, extra: int = 8, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of a linear autoencoder over all spans, by a randomised range finder.

    The leading directions of the centred spans X are found by iterating Q <- orth(X'XQ) from a random Q of k + ``extra``
    columns.  Tasks multiply their sparse spans with Q and add up the products per dimension, for the dimensions they meet
    only; these sums are combined by Spark.  The driver holds matrices of dims x (k + extra), never dims x dims.
    """
    width = min(dims, k + extra)

    def product(q: np.ndarray, mean: np.ndarray) -> np.ndarray:
        shift = mean @ q

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            total: dict[int, np.ndarray] = {}
            for pdf in batches:
                hot, measured, _ = _flat(pdf)
                y = _times(hot, measured, q) - shift
                ones, at = np.unique(hot, return_inverse=True)
                sums = np.zeros((len(ones), q.shape[1]))
                np.add.at(sums, at.reshape(hot.shape)[:, 0], y)
                np.add.at(sums, at.reshape(hot.shape)[:, 1], y)
                parts = [*zip(ones.tolist(), sums), *zip((dims - 2, dims - 1), measured.T @ y), (-1, y.sum(axis=0))]
                for dim, part in parts:
                    total[dim] = total[dim] + part if dim in total else part
            yield pd.DataFrame({"dim": list(total), "part": [p.tolist() for p in total.values()]})

        rows = spans.mapInPandas(run, "dim int, part array<double>")
        cells = rows.select("dim", F.posexplode("part").alias("c", "v")).groupBy("dim", "c").agg(F.sum("v").alias("v"))
        out, whole = np.zeros((dims, q.shape[1])), np.zeros(q.shape[1])
        for r in cells.groupBy("dim").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("row")).toLocalIterator():
            values = [x.v for x in r.row]
            if r.dim < 0:
                whole = np.array(values)
            else:
                out[r.dim] = values
        return out - np.outer(mean, whole)

    counts = spans.select(F.explode("hot").alias("dim")).groupBy("dim").agg(F.count(F.lit(1)).alias("n"))
    values = spans.select(F.explode(F.arrays_zip("seconds", "status")).alias("s")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("s.seconds").alias("seconds"), F.sum("s.status").alias("status")).first()
    mean = np.zeros(dims)
    if not values.n:
        return mean, np.eye(dims, min(k, dims))
    for r in counts.toLocalIterator():
        mean[r.dim] = r.n
    mean[-2:] = values.seconds, values.status
    mean /= values.n
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, width)))[0]
    for _ in range(rounds):
        q = np.linalg.qr(product(q, mean))[0]
    small = q.T @ product(q, mean)
    _, vectors = np.linalg.eigh((small + small.T) / 2)
    return mean, q @ vectors[:, ::-1][:, :k]


def sparse_reconstruction_error(spans: DataFrame, mean: np.ndarray, components: np.ndarray) -> DataFrame:
    """(trace_id, score) as ``reconstruction_error``, from sparse spans and orthonormal ``components``.

    What a projection leaves of a span is its squared length less that of its coordinates, so no span is written out.
    """
    dims = len(mean)
    center, length = mean @ components, float(mean @ mean)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            hot, measured, lengths = _flat(pdf)
            coords = _times(hot, measured, components) - center
            own = 2 + (measured ** 2).sum(axis=1) - 2 * _times(hot, measured, mean[:, None])[:, 0] + length
            left = np.maximum(own - (coords ** 2).sum(axis=1), 0.0) / dims
            total = np.bincount(np.repeat(np.arange(len(lengths)), lengths), weights=left, minlength=len(lengths))
            yield pd.DataFrame({"trace_id": pdf["trace_id"], "score": total / np.maximum(lengths, 1)})

    kind = spans.schema["trace_id"].dataType.simpleString()
    return spans.mapInPandas(run, f"trace_id {kind}, score double")


def flag_above_percentile(scored: DataFrame, q: float = ERROR_PERCENTILE) -> DataFrame:
    limit = exact_percentiles(scored, [], "score", {"threshold": q})
    return scored.join(F.broadcast(limit)).withColumn("is_anomaly", F.col("score") >= F.col("threshold"))  # one row
