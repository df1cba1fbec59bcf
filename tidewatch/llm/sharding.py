"""Sharding by balanced label propagation: linked documents move together while shard sizes stay even."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key, stored, text_or_empty

SHARDS = 8
ROUNDS = 6
#: Running sums go over so many hash slices: sums per slice first, rows only inside a slice.
SLICES = 4096
#: A block of one group in one shard that is larger than this share of a shard moves document by document.
LARGE_BLOCK = 0.01
#: A shard counts as full at this share of its capacity; the rest evens out what hashing leaves uneven.
FULL = 0.97


def balanced_shards(docs: DataFrame, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard, group_size): every document in one shard, law ``bytes``.

    Documents of equal text are linked.  They start spread evenly by a hash; in each round the documents of a group count how
    many of their neighbours each shard holds and ask to move to the shard with most of them.  Requests are granted up to the
    shard's room: whole blocks of a group, or single documents of blocks that are too large.  A full shard stops being a target,
    so a group larger than a shard fills one after the other and is cut as seldom as its size allows.  Documents without links
    have no preference; they are the counterweight, and are dealt out last so that every shard gets the same bytes, up to about
    the size of one document.

    A group is never gathered: rounds work on counts per (group, shard), and rows meet them by salted joins.  ``slot`` numbers
    the documents of a shard from 0.  Size is the UTF-8 length plus 1; null text has length 0 and the checksum of the empty
    text, and null and empty texts form one group.  Rows that repeat an id are documents of their own; null ids are placed like
    others.  Only doc_id and text are read.  An empty table gives no rows.
    """
    text = text_or_empty()
    items = stored(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("grp"),
        F.monotonically_increasing_id().alias("rid")), "shard-items")
    groups = items.groupBy("grp").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    items = stored(join_by_key(items, groups, ["grp"], "rid", how="left").withColumn(
        "slice", F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(SLICES)).cast("int")), "shard-linked")
    total = items.agg(F.sum("size")).first()[0] or 0
    capacity = total / shards
    linked = items.filter("group_size is not null").select("rid", "doc_id", "grp", "size", "slice")
    linked = stored(deal(linked, [1.0] * shards).select("rid", "grp", "size", "slice", "shard"), "shard-state")
    for _ in range(rounds):
        moved = _round(linked, shards, capacity)
        if moved is None:
            break
        linked = moved
    held = _bytes(linked, shards)
    free = deal(items.filter("group_size is null"), [max(capacity - b, 1e-9 * capacity + 1e-9) for b in held])
    placed = free.select("rid", "shard").unionByName(linked.select("rid", "shard")).withColumnRenamed("rid", "_rid")
    out = number(stored(items.join(placed, F.col("rid") == F.col("_rid")).drop("_rid", "grp"), "shard-placed"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"), F.coalesce("group_size", F.lit(1)).alias("group_size"))


def deal(rows: DataFrame, weights: list[float]) -> DataFrame:
    """Give each row a shard so that the shards' sizes are in proportion to ``weights``: equal lengths of a running sum."""
    in_slice = rows.groupBy("slice").agg(F.sum("size").alias("_in"))
    offsets = in_slice.withColumn("_upto", F.sum("_in").over(Window.orderBy("slice")))  # SLICES rows at most
    offsets = offsets.select(F.col("slice").alias("_slice"), (F.col("_upto") - F.col("_in")).alias("_from"),
                             F.sum("_in").over(Window.partitionBy()).alias("_all"))
    run = Window.partitionBy("slice").orderBy("doc_id", "rid").rowsBetween(Window.unboundedPreceding, 0)
    placed = rows.join(F.broadcast(offsets), F.col("slice") == F.col("_slice")) \
        .withColumn("_mid", (F.col("_from") + F.sum("size").over(run) - F.col("size") / 2) / F.col("_all"))
    bounds = [b / sum(weights) for b in accumulate(weights)][:-1]
    shard = sum((F.when(F.col("_mid") >= b, 1).otherwise(0) for b in bounds), F.lit(0))
    return placed.withColumn("shard", shard.cast("int")).drop("_slice", "_from", "_all", "_mid")


def _bytes(state: DataFrame, shards: int) -> list[int]:
    """Bytes per shard: as many numbers as there are shards."""
    held = {r[0]: r[1] for r in state.groupBy("shard").agg(F.sum("size")).collect()}
    return [held.get(s, 0) for s in range(shards)]


def _by_shard(column: str, values: list[float]) -> Column:
    return F.element_at(F.array(*[F.lit(float(v)) for v in values]), F.col(column) + 1)


def _round(state: DataFrame, shards: int, capacity: float) -> DataFrame | None:
    """One round of propagation; None if nothing may or wants to move."""
    held = _bytes(state, shards)
    room = [max(0.0, FULL * capacity - b) for b in held]
    roomy = _by_shard("shard", [float(r > (1 - FULL) * capacity) for r in room]) > 0
    blocks = stored(state.groupBy("grp", "shard").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")), "shard-blocks")
    # of equal counts, a hash of group and shard decides, so that small groups spread over the shards
    rank = F.struct("n", F.xxhash64("grp", "shard").alias("tie"), "shard")
    best = blocks.filter(roomy).groupBy("grp").agg(F.max(rank).alias("best")) \
        .select(F.col("grp").alias("_grp"), F.col("best.shard").alias("target"), F.col("best.n").alias("n_target"))
    wishes = blocks.join(best, F.col("grp") == F.col("_grp")).filter("target <> shard and n_target - n + 1 > 0") \
        .select("grp", "shard", "target", "bytes")
    wishes = stored(wishes, "shard-wishes")
    asked = {r[0]: r[1] for r in wishes.groupBy("target").agg(F.sum("bytes")).collect()}
    if not any(asked.get(s) and room[s] for s in range(shards)):
        return None
    granted = [min(1.0, room[s] / asked[s]) if asked.get(s) else 0.0 for s in range(shards)]
    rows = join_by_key(state, wishes, ["grp", "shard"], "rid", how="left")
    draw = F.pmod(F.when(F.col("bytes") > LARGE_BLOCK * capacity, F.xxhash64("rid", "target"))
                  .otherwise(F.xxhash64("grp", "target")), F.lit(1 << 20)) / float(1 << 20)
    goes = F.col("target").isNotNull() & (draw < _by_shard("target", granted))
    return stored(rows.select("rid", "grp", "size", "slice", F.when(goes, F.col("target")).otherwise(F.col("shard"))
                              .alias("shard")), "shard-state")


def number(rows: DataFrame) -> DataFrame:
    """Add ``slot``: 0, 1, 2, ... within each shard, without sorting a shard in one task."""
    counts = rows.groupBy("shard", "slice").agg(F.count(F.lit(1)).alias("_n"))
    upto = F.sum("_n").over(Window.partitionBy("shard").orderBy("slice"))
    offsets = counts.select(F.col("shard").alias("_shard"), F.col("slice").alias("_slice"), (upto - F.col("_n")).alias("_from"))
    order = Window.partitionBy("shard", "slice").orderBy("doc_id", "rid")
    joined = rows.join(offsets, (F.col("shard") == F.col("_shard")) & (F.col("slice") == F.col("_slice")))
    return joined.withColumn("slot", (F.col("_from") + F.row_number().over(order) - 1).cast("long")) \
        .drop("_shard", "_slice", "_from")
