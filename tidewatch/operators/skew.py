"""Bounded groups for keyed windows and folds.

A single key may own a third of all rows.  Keys above a row limit are found
first (a map-side combined count); only those are cut into blocks, all other
keys keep the plain one-shuffle plan.  Blocks overlap by a *halo* of earlier
rows, so a frame or recurrence that looks back at most ``halo`` rows gives the
same answer inside its block as it would over the whole key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import settle

BLOCK_ROWS = 1_000_000
# A hot list of up to so many keys is broadcast; a longer one is joined by its keys.
MAX_BROADCAST_KEYS = 10_000


def _hot_keys(df: DataFrame, keys: Sequence[str], limit_rows: int) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > limit_rows)
    return counts.select(*[F.col(k).alias(f"_hot_{k}") for k in keys])


def _on_hot(df: DataFrame, hot: DataFrame, keys: Sequence[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(hot[f"_hot_{k}"])
    return cond


def split_hot(df: DataFrame, keys: Sequence[str], limit_rows: int) -> tuple[DataFrame, DataFrame | None]:
    """(rows of ordinary keys, rows of keys with more than ``limit_rows`` rows or None where there are none).

    Keys are counted once, at once; the counts say whether the plan needs a second branch at all.
    """
    hot = settle(_hot_keys(df, keys, limit_rows))
    n = hot.count()
    if n == 0:
        return df, None
    hot = F.broadcast(hot) if n <= MAX_BROADCAST_KEYS else hot
    cond = _on_hot(df, hot, keys)
    return df.join(hot, cond, "left_anti"), df.join(hot, cond, "left_semi")


def row_blocks(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    order: Sequence[str],
    halo: int,
    block_rows: int = BLOCK_ROWS,
    slice_seconds: int = 60,
) -> DataFrame:
    """Add ``_block`` and ``_halo``; every (keys, _block) group is bounded.

    ``order`` must be a total order that starts with ``ts``.  Rows with
    ``_halo`` true are copies that only serve as history: drop them after the
    window.  Ordinals of a hot key come from per-slice counts plus the rank
    inside the slice, so no task ever sorts a whole hot key.
    """
    if halo >= block_rows:
        raise ValueError(f"halo of {halo} rows needs blocks larger than {block_rows}")
    cold, hot = split_hot(df, keys, block_rows)
    cold = cold.withColumn("_block", F.lit(0).cast("long")).withColumn("_halo", F.lit(False))
    if hot is None:
        return cold

    hot = hot.withColumn("_slice", F.floor(F.unix_micros(ts) / F.lit(slice_seconds * 1_000_000)))
    in_slice = Window.partitionBy(*keys, "_slice").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        hot.groupBy(*keys, "_slice")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_offset", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    ranked = hot.withColumn("_rank", F.row_number().over(in_slice))
    offsets = offsets.select(*[F.col(c).alias(f"_o_{c}") for c in [*keys, "_slice"]], "_offset")
    cond = F.col("_slice") == F.col("_o__slice")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    ordinal = F.col("_offset") + F.col("_rank") - 1
    block = F.floor(ordinal / F.lit(block_rows)).cast("long")
    own = F.struct(block.alias("_block"), F.lit(False).alias("_halo"))
    tail = F.struct((block + 1).alias("_block"), F.lit(True).alias("_halo"))
    copies = F.when(ordinal % block_rows >= block_rows - halo, F.array(own, tail)).otherwise(F.array(own))
    hot = ranked.join(offsets, cond).select(*df.columns, F.explode(copies).alias("_b"))
    hot = hot.select(*df.columns, "_b._block", "_b._halo")
    return cold.unionByName(hot)


def equal_depth_pieces(
    df: DataFrame,
    keys: Sequence[str],
    ts: str,
    piece: str = "hour",
    limit_rows: int = BLOCK_ROWS,
    early: Column | None = None,
) -> DataFrame:
    """Add ``_piece``, a struct that orders like time inside a key; no (keys, _piece) holds more than about twice ``limit_rows``.

    Pieces of time with more rows than the limit are cut at equal depth, by running counts per second and, where one second
    is too much, per microsecond.  Rows of a single instant beyond the limit are dealt by a hash; those with ``early`` false
    come after, those with ``early`` true before the dealt ones, as they do inside an instant.
    """
    none = F.lit(0).cast("long")
    coarse = df.withColumn("_p0", F.date_trunc(piece, F.col(ts)))
    level, parent, done = coarse, [*keys, "_p0"], []
    for n, slice_ in ((1, F.unix_seconds(ts)), (2, F.unix_micros(ts))):
        cold, level = split_hot(level, parent, limit_rows)
        zeros = [none.alias(f"_p{k}") for k in range(n, 4)]
        done.append(cold.select("*", *zeros))
        if level is None:
            break
        # rows of hot pieces are stored between the levels, so each level is planned and computed once
        level = settle(_cut_by_counts(level.withColumn("_slice", slice_), parent, limit_rows, f"_p{n}"))
        parent = [*parent, f"_p{n}"]
    else:
        cold, level = split_hot(level, parent, limit_rows)
        done.append(cold.withColumn("_p3", none))
        if level is not None:
            done.append(settle(_deal_instant(level, parent, ts, limit_rows, early)))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out.withColumn("_piece", F.struct("_p0", "_p1", "_p2", "_p3")).drop("_p0", "_p1", "_p2", "_p3")


def join_on(df: DataFrame, small: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by ``keys``, null keys meeting null keys."""
    renamed = small.select(*[F.col(k).alias(f"_o_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    cond = F.lit(True)
    for k in keys:
        cond = cond & df[k].eqNullSafe(renamed[f"_o_{k}"])
    return df.join(renamed, cond).drop(*[f"_o_{k}" for k in keys])


def _cut_by_counts(df: DataFrame, parent: Sequence[str], limit_rows: int, name: str) -> DataFrame:
    """Number the stretches of about ``limit_rows`` rows of each parent piece, along ``_slice``."""
    before = Window.partitionBy(*parent).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = df.groupBy(*parent, "_slice").agg(F.count(F.lit(1)).alias("_n"))
    ahead = F.coalesce(F.sum("_n").over(before), F.lit(0))
    cuts = counts.withColumn(name, F.floor(ahead / F.lit(limit_rows)).cast("long")).drop("_n")
    return join_on(df, cuts, [*parent, "_slice"]).drop("_slice")


def _deal_instant(df: DataFrame, parent: Sequence[str], ts: str, limit_rows: int, early: Column | None) -> DataFrame:
    """Deal the rows of the instant that makes a piece too large: it is the last one of the piece."""
    sizes = df.groupBy(*parent).agg(F.max(ts).alias("_instant"), F.count(F.lit(1)).alias("_n"))
    sizes = sizes.withColumn("_n", F.ceil(F.col("_n") / F.lit(limit_rows)).cast("long"))
    dealt = 1 + F.pmod(F.xxhash64(*[c for c, t in df.dtypes if "map<" not in t and "variant" not in t]), F.col("_n"))
    if early is not None:
        dealt = F.when(early.isNull(), dealt).when(early, F.lit(0).cast("long")).otherwise(F.col("_n") + 1)
    joined = join_on(df, sizes, parent)
    return joined.withColumn("_p3", F.when(F.col(ts) < F.col("_instant"), F.lit(0).cast("long")).otherwise(dealt)).drop("_instant", "_n")


def running_sums(df: DataFrame, keys: Sequence[str], ts: str, value: str, name: str, piece: str = "hour", limit_rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the sum of ``value`` over the rows of a key up to each row; ``ts`` must not repeat inside a key.

    Sums of equal-depth pieces are added up first, one row per piece, so no task sees a whole key.
    """
    rows = equal_depth_pieces(df, keys, ts, piece, limit_rows)
    before = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    ahead = rows.groupBy(*keys, "_piece").agg(F.sum(value).alias("_sum"))
    ahead = ahead.withColumn("_ahead", F.coalesce(F.sum("_sum").over(before), F.lit(0))).drop("_sum")
    upto = Window.partitionBy(*keys, "_piece").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    summed = rows.withColumn("_part", F.sum(value).over(upto))
    return join_on(summed, ahead, [*keys, "_piece"]).select(*df.columns, (F.col("_ahead") + F.col("_part")).alias(name))


def time_blocks(df: DataFrame, seconds: str | Column, block_seconds: int, halo_seconds: int) -> DataFrame:
    """Add ``_block`` and ``_halo`` cut by time, for frames that look back a fixed span.

    Pure arithmetic: rows in the last ``halo_seconds`` of a block are copied
    into the next block, where they only serve as history.
    """
    if halo_seconds > block_seconds:
        raise ValueError("the halo must fit in one block")
    sec = F.col(seconds) if isinstance(seconds, str) else seconds
    block = F.floor(sec / F.lit(block_seconds)).cast("long")
    own = F.struct(block.alias("_block"), F.lit(False).alias("_halo"))
    tail = F.struct((block + 1).alias("_block"), F.lit(True).alias("_halo"))
    near_end = sec >= (block + 1) * F.lit(block_seconds) - F.lit(halo_seconds)
    copies = F.when(near_end, F.array(own, tail)).otherwise(F.array(own))
    out = df.select("*", F.explode(copies).alias("_b"))
    return out.select(*df.columns, "_b._block", "_b._halo")


def trailing_sums(keys: Sequence[str], order: str, span: int, columns: dict[str, str]) -> dict[str, Column]:
    """Sums of whole numbers over rows with ``order`` in [current - span, current].

    The difference of two frames that start at the first row: each row enters
    each frame once, where a sliding frame would add it up again for every row.
    """
    w = Window.partitionBy(*keys).orderBy(order)
    upto = w.rangeBetween(Window.unboundedPreceding, 0)
    before = w.rangeBetween(Window.unboundedPreceding, -span - 1)
    return {name: F.sum(c).over(upto) - F.coalesce(F.sum(c).over(before), F.lit(0)) for name, c in columns.items()}
