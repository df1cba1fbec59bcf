"""Distributed merge sort of suffixes: front-coded sorted runs, merged without comparing a known prefix again."""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import packed, release

#: Bytes of suffixes that a task sorts at a time (a run), and bytes that one range of the order should hold.
RUN_BYTES = 48 << 20
RANGE_BYTES = 16 << 20
#: Bound of what the driver sees: so many ranges at most, and so many sampled suffixes for each.
MAX_RANGES = 16_384
SAMPLES = 8

RUN = "range int, shared binary, sizes binary, rest binary, rids binary, starts binary, tags binary, twins binary"
SORTED = "rid long, start int, size int, tag long, lcp int, first boolean, edge binary, range int"


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the longest common prefix of two strings that share ``known`` bytes already."""
    upto = min(len(a), len(b))
    while known < upto:
        end = min(upto, known + 4096)
        x, y = a[known:end], b[known:end]
        if x != y:
            differing = (int.from_bytes(x, "big") ^ int.from_bytes(y, "big")).bit_length()
            return end - (differing + 7) // 8
        known = end
    return upto


def _runs(splitters: list[bytes], turn: int):
    """Map side: sorts the suffixes of its texts in runs, keeps one of equal ones, cuts the run by range and front-codes it."""

    def settled(members: list[tuple]) -> pd.DataFrame:
        out = pd.DataFrame(members, columns=["rid", "start", "size", "tag"])
        return out.assign(lcp=out["size"], first=False, edge=None, range=-1)

    def coded(run: list[tuple[bytes, int, int, int]]) -> Iterator[dict]:
        run.sort()
        part: dict | None = None
        repeats = []
        last = b""
        for text, rid, start, tag in run:
            if part is not None and text == last:
                part["twins"][-1] = 1
                repeats.append((rid, start, len(text), tag))
                continue
            where = bisect_right(splitters, text)
            if part is None or where != part["range"]:
                if part is not None:
                    yield _packed(part)
                part = {"range": where, **{k: [] for k in ("shared", "sizes", "rest", "rids", "starts", "tags", "twins")}}
                last = b""
            known = common_prefix(last, text)
            for name, value in zip(("shared", "sizes", "rest", "rids", "starts", "tags", "twins"),
                                   (known, len(text), text[known:], rid, start, tag, 0)):
                part[name].append(value)
            last = text
        if part is not None:
            yield _packed(part)
        if repeats:
            yield {"settled": settled(repeats)}

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = [], 0
        for batch in batches:
            for rid, body, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                text = body.as_py()
                for cut in cuts.as_py():
                    start, size = cut["start"], cut["size"]
                    pending.append((text[start:start + size][::turn], rid, start, cut["tag"]))
                    held += size + 150
                if held >= RUN_BYTES:
                    yield from map(_row, coded(pending))
                    pending, held = [], 0
        yield from map(_row, coded(pending))

    return run


def _packed(part: dict) -> dict:
    kinds = {"shared": np.int32, "sizes": np.int32, "rids": np.int64, "starts": np.int32, "tags": np.int64, "twins": np.uint8}
    rest = b"".join(part["rest"])
    return {k: v if k == "range" else pa.compress(rest, codec="zstd", asbytes=True) if k == "rest" else np.array(v, kinds[k]).tobytes()
            for k, v in part.items()}


RUN_TYPES = pa.schema([("range", pa.int32()), *((n, pa.binary()) for n in ("shared", "sizes", "rest", "rids", "starts", "tags", "twins"))])


def _row(part: dict) -> pa.RecordBatch:
    if "settled" in part:  # equal to a suffix of the same run: nothing left to compare
        done = part["settled"]
        part = {"range": -1, "shared": b"", "rest": b"", "twins": b"", "sizes": done["size"].to_numpy(np.int32).tobytes(),
                "rids": done["rid"].to_numpy(np.int64).tobytes(), "starts": done["start"].to_numpy(np.int32).tobytes(),
                "tags": done["tag"].to_numpy(np.int64).tobytes()}
    return pa.RecordBatch.from_pylist([part], schema=RUN_TYPES)


class _Run:
    """Reads a front-coded run: each suffix with the length of the prefix it shares with the one before."""

    def __init__(self, row) -> None:
        self.shared, self.sizes = np.frombuffer(row.shared, np.int32).tolist(), np.frombuffer(row.sizes, np.int32).tolist()
        self.rest = pa.decompress(row.rest, sum(self.sizes) - sum(self.shared), codec="zstd", asbytes=True)
        self.at, self.n, self.text = 0, -1, b""

    def step(self) -> int | None:
        """Moves to the next suffix; its common prefix with the one before, None at the end."""
        self.n += 1
        if self.n == len(self.sizes):
            self.text = None
            return None
        known = self.shared[self.n]
        more = self.sizes[self.n] - known
        self.text = self.text[:known] + self.rest[self.at:self.at + more]
        self.at += more
        return known


def merge_runs(runs: list[_Run]) -> Iterator[tuple[int, int, int, bytes]]:
    """(run, place in the run, common prefix with the suffix before, suffix) in order, by a loser tree.

    Every contender carries the length of the prefix it shares with the last winner.  Of two contenders the one that shares
    more is smaller, without a look at the bytes; only if both share as much are they compared, from that byte on, and the
    loser then carries what it shares with the winner.  So no known prefix is compared again.
    """
    width = 1 << max(0, len(runs) - 1).bit_length()
    known = [0] * width
    text: list[bytes | None] = [None] * width
    for k, run in enumerate(runs):
        run.step()
        text[k] = run.text

    def play(a: int, b: int) -> tuple[int, int]:
        x, y = text[a], text[b]
        if y is None:
            return a, b
        if x is None:
            return b, a
        if known[a] != known[b]:
            return (a, b) if known[a] > known[b] else (b, a)
        both = common_prefix(x, y, known[a])
        wins = both == len(x) or (both < len(y) and x[both] < y[both])
        winner, loser = (a, b) if wins else (b, a)
        known[loser] = both
        return winner, loser

    losers = [0] * width
    ahead = list(range(width))
    level = width
    while level > 1:  # first tournament, from the leaves to the root
        level //= 2
        for j in range(level):
            ahead[j], losers[level + j] = play(ahead[2 * j], ahead[2 * j + 1])
    best = ahead[0]
    while text[best] is not None:
        run = runs[best]
        yield best, run.n, known[best], run.text
        shared = run.step()
        text[best] = run.text
        known[best] = shared or 0
        node = (best + width) // 2
        while node:
            best, losers[node] = play(best, losers[node])
            node //= 2


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """Reduce side: the runs of one range as one order, with the longest prefix each suffix shares with a neighbour."""
    rows = list(rows.itertuples(index=False))
    runs = [_Run(row) for row in rows]
    which, place, lcp, size = [], [], [], []
    ends: list[bytes] = []
    for k, n, known, text in merge_runs(runs):
        which.append(k)
        place.append(n)
        lcp.append(known)
        size.append(len(text))
        ends = [ends[0] if ends else text, text]
    lcp = np.array(lcp, np.int32)
    size = np.array(size, np.int32)
    base = np.cumsum([0] + [len(run.sizes) for run in runs])
    at = base[np.array(which)] + np.array(place)

    def column(name: str, kind) -> np.ndarray:
        return np.concatenate([np.frombuffer(getattr(row, name), kind) for row in rows])[at]

    longest = np.maximum(lcp, np.append(lcp[1:], 0))
    out = pd.DataFrame({"rid": column("rids", np.int64), "start": column("starts", np.int32), "size": size,
                        "tag": column("tags", np.int64), "lcp": np.where(column("twins", np.uint8) > 0, size, longest).astype(np.int32),
                        "first": lcp < size, "edge": None, "range": np.int32(rows[0].range)})
    edge = out["edge"].to_numpy(object)
    edge[0], edge[-1] = ends[0], ends[-1]
    return out.assign(edge=edge)


def _settled(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            size = np.frombuffer(row["sizes"], np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(row["rids"], np.int64)), pa.array(np.frombuffer(row["starts"], np.int32)), pa.array(size),
                 pa.array(np.frombuffer(row["tags"], np.int64)), pa.array(size), pa.array(np.zeros(len(size), bool)),
                 pa.nulls(len(size), pa.binary()), pa.array(np.full(len(size), -1, np.int32))],
                names=["rid", "start", "size", "tag", "lcp", "first", "edge", "range"])


def longest_shared(texts: DataFrame, name: str, backwards: bool = False) -> DataFrame:
    """(rid, start, size, tag, lcp, first): what each suffix shares with its neighbours in the order of all suffixes.

    ``texts`` has (rid long, body binary, cuts array<struct<start int, size int, tag long>>); a cut names the suffix at
    ``start``, of which ``size`` bytes count, and carries a ``tag``; ``backwards`` these bytes are read from their end.  ``lcp`` is the longest prefix the suffix shares with any
    other one (at most its size), ``first`` is false for a suffix that equals one before it.

    A task sorts its suffixes in runs of bounded size, keeps one of equal ones and front-codes the run, so a text that stands
    there a thousand times is sent once.  Runs are cut into ranges by a sample of suffixes (SAMPLES times the number of ranges,
    MAX_RANGES at most), exchanged, and merged per range.  Ranges may split a family of suffixes that share a long prefix, so
    no family must fit in a task; the two suffixes at each cut are compared afterwards.
    """
    spark, turn = texts.sparkSession, -1 if backwards else 1
    total = texts.select(F.size("cuts").alias("n"), F.expr("aggregate(cuts, 0L, (s, c) -> s + c.size)").alias("bytes")) \
        .agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes")).first()
    ranges = min(MAX_RANGES, max(1, -(-(total.bytes or 0) // RANGE_BYTES)))
    share = 1_000_000 if not total.n else min(1_000_000, int(1_000_000 * SAMPLES * ranges / total.n) + 1)
    picked = texts.select("body", F.explode(F.expr(f"filter(cuts, c -> pmod(xxhash64(rid, c.start), 1000000) < {share})")).alias("c"))
    sample = sorted(bytes(r.s)[::turn] for r in picked.select(F.expr("substring(body, c.start + 1, c.size)").alias("s"))
                    .limit(4 * SAMPLES * ranges).collect()) if ranges > 1 else []
    splitters = sorted({sample[k * len(sample) // ranges] for k in range(1, ranges)}) if sample else []

    runs = packed(texts.select("rid", "body", "cuts").mapInArrow(_runs(splitters, turn), RUN), f"{name}-runs")
    done = runs.filter("range = -1").mapInArrow(_settled, SORTED)
    order = runs.filter("range >= 0").groupBy("range").applyInPandas(_merged, SORTED)
    out = packed(order.unionByName(done), f"{name}-order")
    release(runs)
    edges = sorted((r.range, r.edge, r.rid, r.start, r.tag) for r in out.filter("edge is not null").collect())
    grown = []
    for a, b in zip(edges, edges[1:]):
        if a[0] != b[0]:
            shared = common_prefix(a[1], b[1])
            grown += [(x[2], x[3], x[4], shared) for x in (a, b)]
    out = out.select("rid", "start", "size", "tag", "lcp", "first")
    if not grown:
        return out
    more = spark.createDataFrame(grown, "rid long, start int, tag long, more int").groupBy("rid", "start", "tag").agg(F.max("more").alias("more"))
    return out.join(F.broadcast(more), ["rid", "start", "tag"], "left").select(
        "rid", "start", "size", "tag", F.least("size", F.greatest("lcp", F.coalesce("more", F.lit(0)))).alias("lcp"), "first")
