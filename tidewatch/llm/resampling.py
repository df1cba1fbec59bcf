"""Importance resampling towards a target distribution, with n-gram hashes from prefix checksums."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

BUCKETS = 10_000
ORDER = 2
SEED = 7
PERCENT = 25
MIN_WORDS = 20
#: Bytes of text that are scanned together, and the lanes in which they are scanned side by side.
SCAN_BYTES = 4 << 20
LANES = 4096
#: Distances up to this one have a shift table of their own; longer ones are put together from powers of two.
NEAR = 64
ONES = np.uint32(0xFFFFFFFF)


@lru_cache(1)
def _tables() -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(byte table, shift tables of the distances 0 to NEAR, shift tables of the distances 1, 2, 4, ...).

    The table of a distance maps each byte of a state to what becomes of it after so many zero bytes; a shifted state is the sum
    (exclusive or) over its four bytes, because the checksum is linear over GF(2).
    """
    step = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        step = np.where(step & 1, np.uint32(0xEDB88320) ^ (step >> np.uint32(1)), step >> np.uint32(1))
    still = np.stack([np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)])
    near = [still]
    for _ in range(NEAR):
        near.append(step[near[-1] & 255] ^ (near[-1] >> np.uint32(8)))
    powers = [near[1]]
    for _ in range(40):
        powers.append(_apply(powers[-1].ravel(), powers[-1], 0))
    return step, np.concatenate([t.ravel() for t in near]), powers


def _apply(flat: np.ndarray, states: np.ndarray, base: np.ndarray | int) -> np.ndarray:
    out = flat[base + (states & 255)]
    for k in (1, 2, 3):
        out = out ^ flat[base + 256 * k + ((states >> np.uint32(8 * k)) & 255)]
    return out


def shifted(states: np.ndarray, distances: np.ndarray) -> np.ndarray:
    """The states after so many zero bytes."""
    _, near, powers = _tables()
    out = _apply(near, states, np.minimum(distances, NEAR) * 1024)
    far = np.flatnonzero(distances > NEAR)
    if len(far):
        state, left = out[far], distances[far] - NEAR
        for j in range(int(left.max()).bit_length()):
            state = np.where(left >> j & 1, _apply(powers[j].ravel(), state, 0), state)
        out[far] = state
    return out


class PrefixChecksums:
    """Running CRC-32 states of a buffer, from which the CRC-32 of any substring follows.

    The buffer is cut into lanes that are scanned side by side, each from state zero.  If a substring lies in one lane, its
    checksum is the state at its end, without the state at its start shifted by its length: what stood before cancels out.
    Across lanes the state of the whole prefix is used, which is the lane's state and the shifted states of the lanes before.
    """

    def __init__(self, buffer: np.ndarray):
        step = _tables()[0]
        lanes = max(1, min(LANES, len(buffer) // 256))
        self.width = -(-len(buffer) // lanes) if len(buffer) else 1
        padded = np.zeros(lanes * self.width, np.uint8)
        padded[:len(buffer)] = buffer
        columns = np.ascontiguousarray(padded.reshape(lanes, self.width).T)
        self.states = np.zeros((self.width + 1, lanes), np.uint32)
        state = self.states[0]
        for j in range(self.width):
            state = step[(state ^ columns[j]) & 255] ^ (state >> np.uint32(8))
            self.states[j + 1] = state
        carry, at = [np.zeros(1, np.uint32)], np.array([self.width])
        for lane in range(lanes - 1):
            carry.append(shifted(carry[-1], at) ^ self.states[self.width, lane])
        self.carry = np.concatenate(carry)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """CRC-32 of the non-empty substrings [start, end)."""
        first, head = np.divmod(starts, self.width)
        last, tail = np.divmod(ends - 1, self.width)
        before, after = self.states[head, first], self.states[tail + 1, last]
        cross = np.flatnonzero(first != last)
        if len(cross):
            before[cross] ^= shifted(self.carry[first[cross]], head[cross])
            after[cross] ^= shifted(self.carry[last[cross]], tail[cross] + 1)
        return after ^ shifted(before ^ ONES, ends - starts) ^ ONES


#: Bytes of words stay (A-Z lower-cased), all others separate: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` on UTF-8 bytes.
SEPARATOR = 32
FOLD = np.full(256, SEPARATOR, np.uint8)
FOLD[0x80:] = np.arange(0x80, 0x100)
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x61:0x7B] = FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)


def _features(body: np.ndarray, offsets: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, feature counts of each text, buckets of all features text by text)."""
    folded = np.insert(FOLD[body], offsets[1:] - offsets[0], SEPARATOR)
    begins = offsets[:-1] - offsets[0] + np.arange(len(offsets) - 1)
    inside = folded != SEPARATOR
    before = np.concatenate(([False], inside[:-1]))
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(before & ~inside)
    first = np.searchsorted(starts, np.append(begins, len(folded)))
    n_words = np.diff(first)
    # separator-normalised: every word is followed by one separator
    sums = PrefixChecksums(folded[inside | before])
    lengths = ends - starts
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    n_features = sum((np.maximum(n_words - k, 0) for k in range(order)), np.zeros(len(n_words), np.int64))
    out = np.empty(int(n_features.sum()), np.uint16 if buckets <= 1 << 16 else np.uint32)
    place = np.cumsum(n_features) - n_features
    for k in range(order):
        n = np.maximum(n_words - k, 0)
        within = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        word = within + np.repeat(first[:-1], n)
        out[within + np.repeat(place, n)] = sums.of(starts[word], ends[word + k]) % np.uint32(buckets)
        place = place + n
    return n_words, n_features, out


def _scan(order: int, buckets: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, texts = 0, batch.column(1)
            offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + SCAN_BYTES, "right")) - 1)
                body = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[at]:offsets[upto]]
                n_words, n_features, found = _features(body, offsets[at:upto + 1], order, buckets)
                ends = np.concatenate(([0], np.cumsum(n_features))) * found.itemsize
                packed = pa.Array.from_buffers(pa.large_binary(), upto - at, [None, pa.py_buffer(ends), pa.py_buffer(found)])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, upto - at), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                     packed.cast(pa.binary())], names=["doc_id", "n_words", "n_features", "buckets"])
                at = upto

    return run


def hashed_features(docs: DataFrame, text: str = "text", doc_id: Column | None = None, order: int = ORDER,
                    buckets: int = BUCKETS) -> DataFrame:
    """(doc_id, n_words, n_features, buckets): the hash bucket of each n-gram of a text, packed, in one scan of each text.

    A feature is a run of 1 to ``order`` consecutive words joined by one space; its bucket is the CRC-32 of its bytes modulo
    ``buckets``.  The text is separator-normalised once, running checksums are kept, and the checksum of every n-gram is
    derived from two of them.  Memory in a task is a small multiple of SCAN_BYTES, or of the one text that is longer.
    """
    ident = F.col("doc_id").cast("long") if doc_id is None else doc_id
    rows = docs.select(ident.alias("doc_id"), text_or_empty(text).cast("binary").alias("text"))
    return rows.mapInArrow(_scan(order, buckets), "doc_id long, n_words long, n_features long, buckets binary")


def bucket_counts(features: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) of the buckets that occur; counted inside each task first."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            packed = batch.column(0)
            ends = np.frombuffer(packed.buffers()[1], np.int32)[packed.offset:packed.offset + len(packed) + 1]
            if len(packed):
                found = np.frombuffer(packed.buffers()[2] or b"", np.uint8)[ends[0]:ends[-1]].view(kind)
                total += np.bincount(found, minlength=buckets)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["bucket", "n"])

    return features.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(spark, raw: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket: log of its smoothed share in the target over that in the raw texts, in thousandths.

    One number per bucket (``buckets`` is a parameter, 10,000), so it is small however many texts there are.
    """
    every = spark.range(buckets).withColumnRenamed("id", "bucket") \
        .join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(target.withColumnRenamed("n", "t"), "bucket", "left") \
        .na.fill(0, ["s", "t"])
    every = stored(every, "resample-buckets")
    total = every.agg(F.sum("s").alias("s"), F.sum("t").alias("t")).first()
    up = (F.col("t") + 1).cast("double") * F.lit(float(total.s + buckets))
    down = (F.col("s") + 1).cast("double") * F.lit(float(total.t + buckets))
    rows = every.select("bucket", F.floor(F.lit(1000.0) * F.ln(up / down)).alias("gain")).collect()
    gains = np.zeros(buckets, np.int64)
    for row in rows:
        gains[row.bucket] = row.gain
    return gains


def weighted(features: DataFrame, gains: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the floored mean gain of a text's features, 0 where there are none."""
    kind = np.uint16 if len(gains) <= 1 << 16 else np.uint32

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(p.as_buffer(), kind) for p in batch.column(3)]
            weights = [int(gains[f].sum()) // len(f) if len(f) else 0 for f in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(weights, pa.int64())],
                                             names=["doc_id", "n_words", "n_features", "weight"])

    return features.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, seed: int = SEED, percent: int = PERCENT, min_words: int = MIN_WORDS,
             order: int = ORDER, buckets: int = BUCKETS) -> DataFrame:
    """Draw ``percent`` % of the texts without replacement, in proportion to their importance weights.

    (doc_id, n_features, weight, score, rank), one row per row of ``docs``.  Importance is the mean log ratio of feature shares
    in ``target`` (a table with ``text``) and in ``docs``; the draw adds seeded Gumbel noise and takes the highest scores, so it
    is repeatable.  Only texts of ``min_words`` words take part; rank is null for the undrawn.  Ranks come from a distributed
    sort and the row counts of its partitions.

    Null and empty texts have no features, weight 0, and are not drawn.  A null id is hashed as an empty one and sorts after
    equal scores; rows that repeat an id are rows of their own.  Other columns are not read.  An empty ``docs`` gives an empty
    result, an empty ``target`` has share zero everywhere.
    """
    spark = docs.sparkSession
    features = stored(hashed_features(docs, order=order, buckets=buckets), "resample-features")
    wanted = hashed_features(target, doc_id=F.lit(None).cast("long"), order=order, buckets=buckets)
    gains = bucket_gains(spark, bucket_counts(features, buckets), bucket_counts(wanted, buckets), buckets)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") + 0.5) / F.lit(4294967296.0)
    noise = F.floor(F.lit(-1000.0) * F.ln(-F.ln(share)))
    scored = weighted(features, gains).withColumn("score", F.col("weight") + noise)
    able = F.col("n_words") >= min_words
    order_by = [(~able).cast("int").asc(), F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    placed = stored(scored.orderBy(*order_by).withColumn("_at", F.monotonically_increasing_id()), "resample-order")
    part, within = F.shiftright("_at", 33), F.expr("_at & ((1L << 33) - 1)")
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"), F.count_if(able).alias("_able"))
    # one row per partition of the sort
    ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    offsets = sizes.select("_part", F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_ahead"),
                           F.sum("_able").over(everything).alias("_able"))
    ranked = placed.join(F.broadcast(offsets), part == F.col("_part")).withColumn("_rank", F.col("_ahead") + within + 1)
    drawn = able & (F.col("_rank") <= F.expr(f"{percent} * _able div 100"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("_rank")).alias("rank"))
