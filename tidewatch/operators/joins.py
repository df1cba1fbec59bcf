"""As-of and trailing-interval joins as unions and windows, never as pair lists."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.skew import BLOCK_ROWS, join_on, equal_depth_pieces, running_sums, split_hot, time_blocks, trailing_sums
from tidewatch.session import settle


def latest_before(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    values: Sequence[str],
    strict: bool = False,
    piece: str = "hour",
    limit_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every left row with the newest right row of its key at or before its time.

    With ``strict`` only right rows before the left time count.  Two right rows
    at one instant are told apart by their values, so the result is stable.
    Keys are cut into pieces of time (``piece``), and pieces of more than
    ``limit_rows`` rows at equal depth, down to rows of one instant; so a busy
    key is spread over tasks.  The newest right row is carried from piece to
    piece, one small row each.
    """
    # Order inside one instant: right rows first, or last when the match is strict.
    l_rank, r_rank = (0, 1) if strict else (1, 0)
    payload = F.struct(*[F.col(v) for v in values])
    rest = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(*keys, ts, F.lit(l_rank).alias("_side"),
                    F.struct(*[F.col(c) for c in rest]).alias("_left") if rest else F.lit(None).alias("_left"),
                    F.lit(None).cast(right.select(payload.alias("p")).schema["p"].dataType).alias("_right"))
    r = right.groupBy(*keys, ts).agg(F.max(payload).alias("_right"))
    r = r.select(*keys, ts, F.lit(r_rank).alias("_side"), F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), "_right")
    both = l.unionByName(r)
    # At one instant the right row stands before (or, strict, behind) all left rows.
    both = equal_depth_pieces(both, keys, ts, piece, limit_rows, F.when(F.col("_side") == r_rank, F.lit(not strict)))

    # Newest right row of each (key, piece), carried forward over the pieces: one small row per piece.
    has_right = F.when(F.col("_right").isNotNull(), F.col(ts))
    pieces = both.groupBy(*keys, "_piece").agg(F.max_by("_right", has_right).alias("_carry"))
    earlier = Window.partitionBy(*keys).orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.select(*keys, "_piece", F.last("_carry", ignorenulls=True).over(earlier).alias("_carry"))

    w = Window.partitionBy(*keys, "_piece").orderBy(ts, "_side").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_seen", F.last("_right", ignorenulls=True).over(w))
    out = join_on(seen.where(F.col("_side") == l_rank), pieces, [*keys, "_piece"])
    match = F.coalesce("_seen", "_carry")
    cols = [F.col(f"_left.{c}").alias(c) for c in rest]
    return out.select(*keys, ts, *cols, *[match[v].alias(v) for v in values])


def trailing_matches(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    ts: str,
    seconds: int,
    count: str = "matches",
    latest: str = "latest_match",
    limit_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Every left row with the number and the latest time of right rows in the ``seconds`` up to it.

    Rows are cut into time blocks.  In an ordinary block one range frame over
    the union answers all left rows, so the work is linear in the rows of both
    sides, whatever number of pairs the interval holds.  In a block of more
    than ``limit_rows`` rows the count is the difference of two running counts,
    found by as-of joins that cut at equal depth.
    """
    rest = [c for c in left.columns if c not in (*keys, ts)]
    l = left.select(*keys, ts, F.struct(*[F.col(c) for c in rest]).alias("_left"), F.lit(False).alias("_match"))
    r = right.select(*keys, ts, F.lit(None).cast(l.schema["_left"].dataType).alias("_left"), F.lit(True).alias("_match"))
    both = l.unionByName(r).withColumn("_us", F.unix_micros(ts)).withColumn("_sec", F.floor(F.col("_us") / F.lit(1_000_000)))
    # Whole-second blocks: one more second of history covers the fraction.
    both = time_blocks(both, "_sec", max(3600, seconds + 1), seconds + 1)
    span = seconds * 1_000_000
    cold, hot = split_hot(both, [*keys, "_block"], limit_rows)
    out = _matches_in_frames(cold, keys, ts, span, count, latest)
    if hot is not None:
        out = out.unionByName(_matches_by_counts(hot, keys, ts, span, count, latest, limit_rows))
    return out.select(*keys, ts, *[F.col(f"_left.{c}").alias(c) for c in rest], count, latest)


def _matches_in_frames(both: DataFrame, keys: Sequence[str], ts: str, span: int, count: str, latest: str) -> DataFrame:
    both = both.withColumn("_one", F.col("_match").cast("int"))
    seen = Window.partitionBy(*keys, "_block").orderBy("_us").rangeBetween(Window.unboundedPreceding, 0)
    sums = trailing_sums([*keys, "_block"], "_us", span, {count: "_one"})
    out = both.select(
        *keys, ts, "_left", "_match", "_halo", "_us", sums[count].alias(count),
        F.max(F.when(F.col("_match"), F.col(ts))).over(seen).alias("_seen"),
    )
    out = out.where(~F.col("_match") & ~F.col("_halo"))
    recent = F.when(F.unix_micros("_seen") >= F.col("_us") - span, F.col("_seen"))
    return out.select(*keys, ts, "_left", count, recent.alias(latest))


def _matches_by_counts(both: DataFrame, keys: Sequence[str], ts: str, span: int, count: str, latest: str, limit_rows: int) -> DataFrame:
    inside = [*keys, "_block"]
    per = both.where("_match").groupBy(*inside, ts).agg(F.count(F.lit(1)).alias("_n"))
    upto = settle(running_sums(per, inside, ts, "_n", "_upto", "minute", limit_rows).withColumn("_at", F.col(ts)))
    rows = both.where("not _match and not _halo").select(*inside, ts, "_left", F.col(ts).alias("_own"))
    found = latest_before(rows, upto, inside, ts, ["_upto", "_at"], piece="minute", limit_rows=limit_rows)
    found = settle(found).withColumnRenamed("_upto", "_now").withColumnRenamed("_at", "_seen").withColumn(ts, F.timestamp_micros(F.unix_micros("_own") - span))
    found = latest_before(found, upto.drop("_at"), inside, ts, ["_upto"], strict=True, piece="minute", limit_rows=limit_rows)
    matches = F.coalesce("_now", F.lit(0)) - F.coalesce("_upto", F.lit(0))
    recent = F.when(F.unix_micros("_seen") >= F.unix_micros("_own") - span, F.col("_seen"))
    return found.select(*keys, F.col("_own").alias(ts), "_left", matches.alias(count), recent.alias(latest))
