"""Repeated passages, found exactly by sorting suffixes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import packed, prefiltered, release, text_or_empty
from tidewatch.llm.suffix_sort import longest_shared

#: A string of so many bytes that stands twice is removed.
LENGTH = 400
#: Windows of LENGTH bytes among which one start of a suffix is chosen by content.
SPAN = 128
#: Bytes of a text that are hashed at a time.
BLOCK = 1 << 20
#: Rows that a task gathers before it hands them on.
ROWS = 50_000
SALTS = 32
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
MIX = np.uint64(0xD6E8FEB86659FD93)
CUTS = "array<struct<start int, size int, tag long>>"


class _Hashes:
    """Hashes of all substrings of one width, from running sums of bytes times powers of an odd base."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, body: np.ndarray, width: int) -> np.ndarray:
        n = len(body)
        if len(self.up) <= n:
            size = 1 << n.bit_length()
            self.up, self.down = (np.multiply.accumulate(np.append(np.ones(1, np.uint64), np.full(size, b, np.uint64)))
                                  for b in (BASE, INVERSE))
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum((body.astype(np.uint64) + np.uint64(1)) * self.up[:n], out=sums[1:])
        out = (sums[width:] - sums[:-width]) * self.down[:n - width + 1]
        out ^= out >> np.uint64(32)
        out *= MIX
        return out ^ (out >> np.uint64(29))


def _least(values: np.ndarray, span: int) -> np.ndarray:
    """The least of every ``span`` neighbouring values, by minima from both sides of fixed blocks."""
    n = len(values) - span + 1
    padded = np.full(-(-len(values) // span) * span, np.uint64(2**64 - 1))
    padded[:len(values)] = values
    blocks = padded.reshape(-1, span)
    upto = np.minimum.accumulate(blocks, axis=1).ravel()
    since = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(since[:n], upto[span - 1:span - 1 + n])


def _anchor_places(values: np.ndarray, span: int) -> np.ndarray:
    """For each window the place of the least of its first ``span`` hashes, the leftmost of equal ones."""
    least = _least((values & ~np.uint64(0xFFFFFF)) | np.arange(len(values), dtype=np.uint64), span)
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def window_starts(body: np.ndarray, hashes: _Hashes, length: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(core, lo, hi, size), an array each: the windows of ``length`` bytes starting at lo..hi hold one anchor, with the hash ``core``.

    The anchor of a window is the place of the least hash among its ``span`` first substrings of ``length - span + 1`` bytes
    (the leftmost such place).  It depends on the bytes of the window alone, so equal windows have equal cores, at the same
    distance.  ``size`` bytes from lo on are compared.  In periodic text each period has its own anchor with the same core:
    such a row of anchors is given as two, a period apart, the second of which stands for all but the first.
    """
    core, n_windows = length - span + 1, len(body) - length + 1
    found: list[list[np.ndarray]] = []
    for at in range(0, n_windows, BLOCK):
        block = body[at:at + BLOCK + length - 1]
        values = hashes.of(block, core)
        anchors = _anchor_places(values, span)
        begins = np.append(0, np.flatnonzero(np.diff(anchors)) + 1)
        ends = np.append(begins[1:], len(anchors)) - 1
        places = anchors[begins]
        part = [places + at, values[places].view(np.int64), begins + at, ends + at]
        if found and found[-1][0][-1] == part[0][0]:  # an anchor on both sides of a block's end
            found[-1][3][-1] = part[3][0]
            part = [x[1:] for x in part]
        if len(part[0]):
            found.append(part)
    _, names, lo, hi = (np.concatenate(x) for x in zip(*found))
    size = hi - lo + length
    begins = np.append(0, np.flatnonzero(names[1:] != names[:-1]) + 1)
    ends = np.append(begins[1:], len(names)) - 1
    rows = ends - begins >= 2
    if not rows.any():
        return names, lo, hi, size
    first, last = begins[rows], ends[rows]
    size[first + 1] = hi[last] - lo[first + 1] + length
    size[first] = np.minimum(size[first + 1], len(body) - lo[first])
    hi[first + 1] = hi[last]
    two = np.arange(len(names)) - np.repeat(begins, ends - begins + 1) < 2
    return names[two], lo[two], hi[two], size[two]


def _gathered(parts: Iterable[tuple], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Columns of many texts as few batches."""
    held, n = [], 0
    for part in parts:
        held.append(part)
        n += len(part[0])
        if n >= ROWS:
            yield _batch(held, schema)
            held, n = [], 0
    if held:
        yield _batch(held, schema)


def _batch(parts: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), f.type) for c, f in zip(zip(*parts), schema)], schema=schema)


ANCHORS = pa.schema([("rid", pa.int64()), ("tag", pa.int64()), ("start", pa.int32()), ("last", pa.int32()), ("size", pa.int32())])


def _anchors(length: int, span: int):
    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = _Hashes()
        for batch in batches:
            for rid, body in zip(batch.column(0).to_pylist(), batch.column(1)):
                columns = window_starts(np.frombuffer(body.as_buffer(), np.uint8), hashes, length, span)
                yield np.full(len(columns[0]), rid), *columns

    return lambda batches: _gathered(found(batches), ANCHORS)


def _shared(rows: DataFrame, key: str) -> DataFrame:
    """Rows of the groups of ``key`` that have two rows or more, one of them open, with the first and last place of the group.

    Rows need (rid, start, open).  The keys that matter are counted first, on their own; most other rows leave by a bitmap of
    these keys (a few more may stay).  Places are combined per (key, salt) before they meet per key, and rows join the salted
    groups, so a key that holds a third of the rows is spread over SALTS tasks.
    """
    wanted = packed(rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.max("open").alias("o")).filter("n > 1 and o").select(key), "suffix-keys")
    salted = prefiltered(rows, key, wanted).withColumn("_salt", F.pmod(F.xxhash64("rid", "start"), F.lit(SALTS)).cast("int"))
    place = F.struct("rid", "start")
    parts = salted.groupBy(key, "_salt").agg(F.min(place).alias("a"), F.max(place).alias("z"))
    groups = parts.groupBy(key).agg(F.min("a").alias("low"), F.max("z").alias("high")).filter(F.col("low") != F.col("high"))
    named = parts.select(key, "_salt").join(groups, key)
    return salted.join(named, [key, "_salt"]).drop("_salt")


def _with_cuts(texts: DataFrame, cuts: DataFrame, columns: list[str]) -> DataFrame:
    """(rid, body, cuts): each text that has cuts, with all of them in order; cuts at one byte are kept side by side."""
    lists = cuts.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct(*columns))).alias("cuts"))
    return texts.select("rid", "body").join(lists, "rid")


WINDOW_ROWS = pa.schema([("rid", pa.int64()), ("start", pa.int32()), ("last", pa.int32()), ("key", pa.int64()), ("open", pa.bool_()),
                         ("since", pa.int32()), ("until", pa.int32())])


def _windows(length: int, span: int, group: int):
    """Groups of up to ``group`` neighbouring windows of one anchor, with a hash of what all of them hold in common.

    Windows at the distances b, ..., b + group - 1 before the anchor share ``length - group + 1`` bytes.  Equal windows lie at
    equal distances, so if any window of a group is repeated, these bytes are, in a group of the same distances.  The cuts of
    a text are hashed together.
    """

    def found(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple]:
        hashes = _Hashes()
        for batch in batches:
            for rid, body, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
                data = np.frombuffer(body.as_buffer(), np.uint8)
                start, last, since, until = (c.to_numpy() for c in cuts.values.flatten())
                for at in range(0, int(last.max()) + 1, BLOCK):
                    here = (start < at + BLOCK) & (last >= at)
                    if here.any():
                        lo, hi = np.maximum(start[here], at), np.minimum(last[here], at + BLOCK - 1)
                        yield rid, data, lo.astype(np.int64), hi.astype(np.int64), since[here], until[here], hashes

    def grouped(rid, data, lo, hi, since, until, hashes) -> tuple:
        base = int(lo.min())
        block = data[base:int(hi.max()) + length]
        sizes = hi - lo + 1
        cut = np.repeat(np.arange(len(lo)), sizes)
        places = np.arange(len(cut)) + np.repeat(lo - base - (np.cumsum(sizes) - sizes), sizes)
        anchors = _anchor_places(hashes.of(block, length - span + 1), span)[places]
        bucket = (anchors - places) // group
        begins = np.append(0, np.flatnonzero((np.diff(cut) != 0) | (np.diff(anchors) != 0) | (np.diff(bucket) != 0)) + 1)
        ends = np.append(begins[1:], len(places)) - 1
        keys = hashes.of(block, length - group + 1)[anchors[begins] - bucket[begins] * group]
        first, final, since, until = places[begins] + base, places[ends] + base, since[cut[begins]], until[cut[begins]]
        return np.full(len(begins), rid), first, final, keys.view(np.int64), (final >= since) & (first <= until), since, until

    return lambda batches: _gathered((grouped(*x) for x in found(batches)), WINDOW_ROWS)


WINDOWS = "rid long, start int, last int, key long, open boolean, since int, until int"


def shared_starts(texts: DataFrame, length: int = LENGTH, span: int = SPAN) -> tuple[DataFrame, DataFrame]:
    """Anchors of the texts (rid, body) whose core stands twice (rid, start, last, size, tag), and the texts that have one.

    Both are stored; the texts come with their cuts.
    """
    anchors = packed(texts.select("rid", "body").mapInArrow(_anchors(length, span), "rid long, tag long, start int, last int, size int"), "suffix-anchors")
    kept = _shared(anchors.withColumn("open", F.lit(True)), "tag").select("rid", "start", "last", "size", "tag")
    kept = packed(kept, "suffix-starts")
    release(anchors)
    busy = packed(_with_cuts(prefiltered(texts.select("rid", "body"), "rid", kept.select("rid").distinct()), kept, ["start", "size", "tag"]), "suffix-texts")
    return kept, busy


def repeated_parts(kept: DataFrame, busy: DataFrame, length: int = LENGTH, span: int = SPAN) -> DataFrame:
    """(rid, start, size): parts of the texts all of whose strings of ``length`` bytes start somewhere else as well.

    Together the parts cover every byte that has to go.  Takes the tables of ``shared_starts``; each stored table is deleted
    as soon as those made of it are stored.

    1. Every window of ``length`` bytes has an anchor chosen by its own bytes (``window_starts``).  Windows whose anchor's core
       is unique in the corpus cannot be repeated and take no further part: counts of hashes decide this, and an equal hash only
       keeps a window in.
    2. For every other anchor the suffix at its first window is sorted among all of them, so that the longest prefix shared
       with any other is known.  It settles the windows that lie in that prefix, exactly.
    3. Anchors with windows left, and one of each kind that shares their core, are sorted once more by the bytes read backwards from
       the end of their last window.  That settles the windows between the place where a repeat begins and its first anchor.
    4. What is left are unique windows, and short repeats whose windows all belong to one anchor.  For these groups of
       windows, and of what remains each window, are hashed; rows of windows that meet the same partner at the same distance
       make one part, and the suffixes at both its ends are sorted as before.  Again the sort decides, the hashes only propose.
    """
    order = longest_shared(busy, "suffix")
    placed = order.join(kept.select("rid", "start", "last"), ["rid", "start"]) \
        .withColumn("since", F.greatest("start", F.expr(f"start + lcp - {length} + 1"))) \
        .withColumn("open", F.col("since") <= F.col("last"))
    columns = ["rid", "start", "last", "since", "first", "open", "tag"]
    last = packed(_shared(placed.filter("open or first").select(*columns), "tag").select(*columns), "suffix-doubtful")
    release(kept)
    cuts = last.select("rid", "start", (F.col("last") - F.col("start") + length).alias("size"), "tag")
    texts = packed(_with_cuts(busy, cuts, ["start", "size", "tag"]), "suffix-back")
    back = longest_shared(texts, "suffix-back", backwards=True)
    release(texts)
    until = F.least("last", F.when(F.col("lcp") >= length, F.expr(f"last + {length} - lcp - 1")).otherwise(F.col("last")))
    doubtful = last.join(back.select("rid", "start", "lcp"), ["rid", "start"]).withColumn("until", until) \
        .withColumn("open", F.col("since") <= F.col("until"))
    doubtful = _shared(doubtful.filter("open or first").select("rid", "start", "last", "since", "until", "open", "tag"), "tag")
    for group in sorted({max(1, span // 16), 1}, reverse=True):
        windows = _with_cuts(busy, doubtful, ["start", "last", "since", "until"]).mapInArrow(_windows(length, span, group), WINDOWS)
        windows = packed(windows, "suffix-windows")
        release(last)
        doubtful, last = _shared(windows, "key"), windows
    met = doubtful.filter("open")
    own = F.struct("rid", "start")
    met = met.withColumn("other", F.when(own == F.col("low"), F.col("high")).otherwise(F.col("low"))) \
        .select("rid", "start", F.col("other.rid").alias("to"), (F.col("start") - F.col("other.start")).alias("shift"))
    rows = Window.partitionBy("rid", "to", "shift").orderBy("start")
    parts = met.withColumn("run", F.col("start") - F.row_number().over(rows)).groupBy("rid", "to", "shift", "run") \
        .agg(F.min("start").alias("start"), (F.count(F.lit(1)) + length - 1).cast("int").alias("size"))
    both = F.explode(F.array(F.struct("rid", "start", "size"), F.struct(F.col("to").alias("rid"), (F.col("start") - F.col("shift")).alias("start"), "size")))
    cuts = parts.select(both.alias("c")).groupBy("c.rid", "c.start").agg(F.max("c.size").alias("size")).withColumn("tag", F.lit(0).cast("long"))
    texts = packed(_with_cuts(busy, cuts, ["start", "size", "tag"]), "suffix-rest")
    release(last)
    rest = longest_shared(texts, "suffix-rest")
    release(texts)
    ahead = order.unionByName(rest).filter(F.col("lcp") >= length).select("rid", "start", F.col("lcp").alias("size"))
    behind = back.filter(F.col("lcp") >= length).select("rid", (F.col("start") + F.col("size") - F.col("lcp")).alias("start"), F.col("lcp").alias("size"))
    return ahead.unionByName(behind)


def _cut_out(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for rid, body, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2).to_pylist()):
            text, spans = memoryview(body.as_buffer()), []
            for cut in cuts:
                start, end = cut["start"], cut["start"] + cut["size"]
                if spans and start <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], end)
                else:
                    spans.append([start, end])
            rest, at = [], 0
            for start, end in spans:
                rest.append(text[at:start])
                at = end
            left = b"".join([*rest, text[at:]])
            rows.append({"rid": rid, "removed": len(text) - len(left), "spans": len(spans), "kept_bytes": left})
        yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(
            [("rid", pa.int64()), ("removed", pa.int64()), ("spans", pa.int64()), ("kept_bytes", pa.binary())]))


def without_repeats(docs: DataFrame, length: int = LENGTH, span: int = SPAN, with_bytes: bool = True) -> DataFrame:
    """Texts without the bytes covered by a string of ``length`` bytes that also starts anywhere else in the corpus.

    (doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept_bytes]), one row per row of ``docs``.  Texts are UTF-8 bytes; strings do not cross
    texts, may overlap, may stand in one text twice, and are judged on the texts as they come in, so no copy is spared.  The
    result is bytes: a cut may fall inside a character.

    Null counts as empty; texts shorter than ``length`` keep all.  Rows that repeat an id are texts of their own (a repeated row
    of ``length`` bytes removes both); null ids stay null.  Only doc_id and text are read.  An empty table gives an empty result.
    """
    body = text_or_empty().cast("binary")
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), body.alias("body"))
    rows = packed(rows.withColumn("n_bytes", F.length("body").cast("long")), "suffix-bodies")
    kept, busy = shared_starts(rows.filter(F.col("n_bytes") >= length), length, span)
    heads = rows.withColumn("sha", F.sha2("body", 256))
    if not with_bytes:
        heads = packed(heads.drop("body"), "suffix-heads")
        release(rows)
    parts = repeated_parts(kept, busy, length, span)
    touched = prefiltered(busy.select("rid", "body"), "rid", parts.select("rid").distinct())
    cut = _with_cuts(touched, parts, ["start", "size"]).mapInArrow(_cut_out, "rid long, removed long, spans long, kept_bytes binary")
    cut = cut.select(F.col("rid").alias("_rid"), "removed", "spans", F.sha2("kept_bytes", 256).alias("kept"), *(["kept_bytes"] if with_bytes else []))
    out = heads.join(cut, F.col("rid") == F.col("_rid"), "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("removed", zero).alias("n_removed"), F.coalesce("spans", zero).alias("n_spans"),
                      F.coalesce("kept", "sha").alias("kept_sha256"),
                      *([F.coalesce("kept_bytes", "body").alias("kept_bytes")] if with_bytes else []))
