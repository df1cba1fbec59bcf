"""Isolation forest and random cut forest as Spark jobs.

Trees are grown in parallel, one bounded sample per task; the model is a node
table whose size follows from the parameters alone.  Scoring streams the rows
through the nodes in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidewatch.operators.quantiles import exact_percentiles

# Tree counts, samples per tree, seed and score limits of the two forests.
ISOLATION_TREES, ISOLATION_SAMPLES = 200, 256
CUT_TREES, CUT_SAMPLES = 100, 512
SEED = 42
STRONG_CUT_SCORE = 3.0
BATCH_LIMIT, TOP_SHARE, SMALL_BATCH_SCORE = 100, 0.99, 0.5
EULER_GAMMA = 0.5772156649015329
_CHUNK = 512

NODES = "tree int, node int, left int, right int, dim int, cut double, mass int, depth int, lo array<double>, hi array<double>"


@dataclass(frozen=True)
class Layout:
    """How a row becomes a vector: plain columns, or sparse (indices, values) of ``dims`` dimensions."""

    columns: tuple[str, ...]
    dims: int
    sparse: bool = False

    def matrix(self, pdf: pd.DataFrame) -> np.ndarray:
        if not self.sparse:
            return pdf[list(self.columns)].to_numpy(dtype=float)
        x = np.zeros((len(pdf), self.dims))
        for row, (i, v) in enumerate(zip(pdf[self.columns[0]], pdf[self.columns[1]])):
            x[row, np.asarray(i, dtype=int)] = v
        return x


def dense(columns: Sequence[str]) -> Layout:
    return Layout(tuple(columns), len(columns))


def sparse(dims: int) -> Layout:
    return Layout(("indices", "values"), dims, True)


def _where_weighed(run: Callable, schema: str, rows: int = 1) -> tuple[Callable, str]:
    """``run``, which makes data frames from data frames, over Arrow batches taken together to so many rows; and its schema."""
    kinds = to_arrow_schema(StructType.fromDDL(schema))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        some: list[pa.RecordBatch] = []
        for batch in batches:
            some.append(batch)
            if sum(b.num_rows for b in some) >= rows:
                yield pa.Table.from_batches(some).to_pandas(integer_object_nulls=True)
                some = []
        if some:
            yield pa.Table.from_batches(some).to_pandas(integer_object_nulls=True)

    def in_arrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for out in run(frames(batches)):
            yield pa.RecordBatch.from_pandas(out, schema=kinds, preserve_index=False)

    return in_arrow, schema


def tree_samples(df: DataFrame, key: str, layout: Layout, trees: int, samples: int, seed: int) -> DataFrame:
    """(tree, h, vector columns): about 1.5 times ``samples`` rows of the whole table for every tree.

    Each row enters each tree by chance with one and the same share, drawn from hashes of its key.  The first tree a row enters
    is drawn at once (the waiting time of such trials is geometric), so rows that enter none leave before anything is
    multiplied; later trees are tried one by one.
    """
    share = min(1.0, 1.5 * samples / max(df.count(), 1))
    unit = float(1 << 30)

    def draw(*what: Column) -> Column:
        return F.pmod(F.xxhash64(F.col(key), *what), F.lit(1 << 30))

    if share < 1.0:
        waiting = F.floor(F.log1p(-draw(F.lit(seed)) / unit) / F.log1p(F.lit(-share))).cast("int")
        rows = df.select(key, *layout.columns, waiting.alias("_first")).where(F.col("_first") < trees)
        later = F.when(F.col("_first") + 1 < trees, F.sequence(F.col("_first") + 1, F.lit(trees - 1)))
        entered = F.filter(later, lambda t: draw(t, F.lit(seed + 2)) < int(share * unit))
        rows = rows.withColumn("tree", F.explode(F.concat(F.array("_first"), F.coalesce(entered, F.array().cast("array<int>")))))
    else:
        rows = df.select(key, *layout.columns, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    return rows.select("tree", draw(F.col("tree"), F.lit(seed + 1)).alias("h"), key, *layout.columns)


def _grow(x: np.ndarray, rng: np.random.Generator, limit: int, by_range: bool, boxes: bool) -> list[tuple]:
    """Nodes of one tree: random cuts until the depth limit or until all points of a node agree."""
    nodes: list[list] = []
    todo = [(np.arange(len(x)), 0, -1, 0)]
    while todo:
        rows, depth, parent, side = todo.pop()
        part = x[rows]
        lo, hi = part.min(axis=0), part.max(axis=0)
        me = len(nodes)
        nodes.append([me, -1, -1, -1, 0.0, len(rows), depth, lo.tolist() if boxes else None, hi.tolist() if boxes else None])
        if parent >= 0:
            nodes[parent][1 + side] = me
        span = hi - lo
        free = np.flatnonzero(span > 0)
        if depth >= limit or len(rows) < 2 or not len(free):
            continue
        p = span[free] / span[free].sum() if by_range else None
        d = int(rng.choice(free, p=p))
        cut = float(rng.uniform(lo[d], hi[d]))
        goes = part[:, d] <= cut
        if goes.all() or not goes.any():
            continue
        nodes[me][3], nodes[me][4] = d, cut
        todo.append((rows[~goes], depth + 1, me, 1))
        todo.append((rows[goes], depth + 1, me, 0))
    return [tuple(n) for n in nodes]


def _fit(df: DataFrame, key: str, layout: Layout, trees: int, samples: int, seed: int, limit: int, by_range: bool,
         vectors: Callable | None = None) -> DataFrame:
    # Growing is heavy for its few bytes, so the number of tasks follows the trees, not the data size.
    tasks = min(trees, df.sparkSession.sparkContext.defaultParallelism)

    def grown(tree: int, x: np.ndarray) -> pd.DataFrame:
        nodes = _grow(x, np.random.default_rng([seed, tree]), limit, by_range, boxes=by_range)
        return pd.DataFrame([(tree, *n) for n in nodes], columns=["tree", "node", "left", "right", "dim", "cut", "mass", "depth", "lo", "hi"])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return grown(int(pdf["tree"].iloc[0]), layout.matrix(pdf.sort_values(["h", key]).head(samples)))

    def run_sorted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, parts, room = -1, [], 0
        for pdf in batches:
            for at, part in pdf.groupby("tree", sort=False):
                if at != tree:
                    if parts:
                        yield grown(tree, np.concatenate(parts))
                    tree, parts, room = int(at), [], samples
                if room:
                    parts.append(layout.matrix(part.head(room)))
                    room -= len(parts[-1])
        if parts:
            yield grown(tree, np.concatenate(parts))

    if vectors is None:
        return tree_samples(df, key, layout, trees, samples, seed).repartition(tasks, "tree").groupBy("tree").applyInPandas(run, NODES)
    # Rows move as they are stored, and are made vectors where their trees grow.
    raw = replace(layout, columns=tuple(c for c in df.columns if c != key))
    picked = tree_samples(df, key, raw, trees, samples, seed).repartition(tasks, "tree").sortWithinPartitions("tree", "h", key)
    return vectors(picked, *_where_weighed(run_sorted, NODES))


def fit_isolation_forest(df: DataFrame, key: str, layout: Layout, trees: int = ISOLATION_TREES,
                         samples: int = ISOLATION_SAMPLES, seed: int = SEED, vectors: Callable | None = None) -> DataFrame:
    """Node table of an isolation forest: at most trees * 2 * samples rows.

    ``vectors`` makes the vector columns from the others of ``df``, row by row, of rows drawn for a tree only; it gets the rows,
    what the task does with their batches, and the schema of that.
    """
    return _fit(df, key, layout, trees, samples, seed, int(np.ceil(np.log2(max(samples, 2)))), by_range=False, vectors=vectors)


def fit_cut_forest(df: DataFrame, key: str, layout: Layout, trees: int = CUT_TREES, samples: int = CUT_SAMPLES, seed: int = SEED) -> DataFrame:
    """Node table of a random cut forest: cut dimensions drawn by range, nodes with bounding boxes."""
    return _fit(df, key, layout, trees, samples, seed, 10_000, by_range=True)


def average_path(n: np.ndarray) -> np.ndarray:
    """Mean depth of an unsuccessful search among ``n`` points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    c = 2.0 * (np.log(big - 1.0) + EULER_GAMMA) - 2.0 * (big - 1.0) / big
    return np.where(n > 2, c, np.where(n == 2, 1.0, 0.0))


def _trees(model: pd.DataFrame) -> list[dict[str, np.ndarray]]:
    out = []
    for _, t in model.sort_values(["tree", "node"]).groupby("tree"):
        tree = {c: t[c].to_numpy() for c in ("left", "right", "dim", "cut", "mass", "depth")}
        if t["lo"].iloc[0] is not None:
            tree["lo"], tree["hi"] = np.stack(t["lo"].tolist()), np.stack(t["hi"].tolist())
        out.append(tree)
    return out


def _isolation_scores(x: np.ndarray, trees) -> np.ndarray:
    depth = np.zeros(len(x))
    for t in trees:
        at = np.zeros(len(x), dtype=int)
        rows = np.arange(len(x))
        while True:
            inner = rows[t["dim"][at[rows]] >= 0]
            if not len(inner):
                break
            node = at[inner]
            left = x[inner, t["dim"][node]] <= t["cut"][node]
            at[inner] = np.where(left, t["left"][node], t["right"][node])
            rows = inner
        depth += t["depth"][at] + average_path(t["mass"][at])
    size = max(t["mass"][0] for t in trees)
    return np.power(2.0, -depth / (len(trees) * float(average_path(size))))


def _cut_scores(x: np.ndarray, trees) -> np.ndarray:
    """Mean over trees of the expected score of inserting each point (published formulation).

    Walking down, a point is cut off at a node with the probability its box
    would grow by; being cut off at depth d scores 1/(d+1), and landing on an
    equal leaf scores less the more mass the leaf has.
    """
    total = np.zeros(len(x))
    for t in trees:
        at, alive, score = np.zeros(len(x), dtype=int), np.ones(len(x)), np.zeros(len(x))
        rows = np.arange(len(x))
        size = float(t["mass"][0])
        while len(rows):
            node = at[rows]
            lo, hi = t["lo"][node], t["hi"][node]
            out = (np.maximum(x[rows] - hi, 0) + np.maximum(lo - x[rows], 0)).sum(axis=1)
            span = (hi - lo).sum(axis=1)
            depth, mass = t["depth"][node], t["mass"][node]
            leaf = t["dim"][node] < 0
            equal = (1 - mass / (2 * size)) / (depth + np.log2(mass + 1.0))
            p = np.divide(out, out + span, out=np.zeros(len(rows)), where=(out + span) > 0)
            cut_off = 1.0 / (depth + 1.0)
            p_end = np.where(leaf, np.where(out > 0, 1.0, 0.0), p)
            score[rows] += alive[rows] * p_end * cut_off
            alive[rows] *= 1 - p_end
            score[rows] += np.where(leaf, alive[rows] * equal, 0.0)
            inner = rows[~leaf]
            node = at[inner]
            left = x[inner, t["dim"][node]] <= t["cut"][node]
            at[inner] = np.where(left, t["left"][node], t["right"][node])
            rows = inner
        total += score * np.log2(1.0 + size)
    return total / len(trees)


def _score(df: DataFrame, key: str, layout: Layout, model: DataFrame, how: Callable, tasks: int | None, vectors: Callable | None = None) -> DataFrame:
    nodes = df.sparkSession.sparkContext.broadcast(model.toPandas())  # bounded by the forest parameters
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        trees = _trees(nodes.value)
        for pdf in batches:
            for start in range(0, len(pdf), _CHUNK):
                part = pdf.iloc[start:start + _CHUNK]
                yield pd.DataFrame({key: part[key].to_numpy(), "score": how(layout.matrix(part), trees)})

    out = f"`{key}` {kind}, score double"
    rows = df if vectors else df.select(key, *layout.columns)
    # A small table may sit in one partition although every row costs many tree walks.
    rows = rows if tasks is None else rows.repartition(tasks)
    return vectors(rows, *_where_weighed(run, out, _CHUNK // 2)) if vectors else rows.mapInPandas(run, out)


def isolation_scores(df: DataFrame, key: str, layout: Layout, model: DataFrame, tasks: int | None = None, vectors: Callable | None = None) -> DataFrame:
    """(key, score) in 0..1, higher is more anomalous; ``vectors`` as for the fit."""
    return _score(df, key, layout, model, _isolation_scores, tasks, vectors)


def cut_scores(df: DataFrame, key: str, layout: Layout, model: DataFrame, tasks: int | None = None) -> DataFrame:
    """(key, score), about one for ordinary points, beyond three for strong anomalies."""
    return _score(df, key, layout, model, _cut_scores, tasks)


def serving_flags(scored: DataFrame) -> DataFrame:
    """Flag the top one percent of a batch of at least 100 rows, else scores above one half."""
    limit = exact_percentiles(scored, [], "score", {"_p": TOP_SHARE})
    n = scored.agg(F.count(F.lit(1)).alias("_n"))
    out = scored.join(F.broadcast(limit)).join(F.broadcast(n))  # one row each
    flag = F.when(F.col("_n") >= BATCH_LIMIT, F.col("score") >= F.col("_p")).otherwise(F.col("score") > SMALL_BATCH_SCORE)
    return out.withColumn("is_anomaly", flag).drop("_p", "_n")
