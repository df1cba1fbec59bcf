"""Connected components of an edge list, by star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges`` (a, b longs): the smallest node that can be reached.

    Alternating star steps hang neighbours to the smallest node in sight until every node points at its component; the number
    of rounds grows with the logarithm of the component, whatever its diameter.  A node with very many neighbours is the
    centre of a star already: its minimum is combined before the shuffle, and the join back is one row per centre.
    """
    now = stored(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    mark = _mark(now)
    while True:
        now = stored(_small_star(_large_star(now)), "edges")
        before, mark = mark, _mark(now)
        if mark == before:
            break
    roots = now.select(F.col("v").alias("node")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(
        roots.withColumn("component", F.col("node")))


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node with the least node of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    joined = both.join(least, F.col("u") == F.col("c")).filter("v > u")
    return joined.select(F.col("v").alias("u"), F.least("m", "c").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours with the least of them."""
    least = edges.groupBy(F.col("u").alias("c")).agg(F.min("v").alias("m"))
    joined = edges.join(least, F.col("u") == F.col("c"))
    moved = joined.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select(F.col("c").alias("u"), F.col("m").alias("v"))).distinct()
