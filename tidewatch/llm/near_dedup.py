"""Near duplicates by circulant MinHash, banding and exact verification."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key, prefiltered, stored, text_or_empty
from tidewatch.llm.components import components

SHINGLE = 5
#: Linked if PERCENT of the union, or more, lies in the intersection.
PERCENT = 75
#: At similarity 0.75 a pair shares no band with probability (1 - 0.75**ROWS)**BANDS, about 1e-8.
BANDS, ROWS = 48, 4
SEED = 0x9E3779B9
MAX_WORDS = 400_000
BLANK = re.compile(rb"[\x20\x09-\x0d]")
#: Shingles whose signatures are computed together, so that the arrays stay in the processor's cache.
TOGETHER = 32_768
#: Nodes of a block, and shingles of a slice of it, when the rest of a family is compared.
BLOCK, SLICE = 256, 4096
_POWERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD],
                   dtype=np.uint64)


class Shingler:
    """Distinct hashed shingles of a text.  Words are hashed to 64 bits once and remembered up to a bound."""

    def __init__(self) -> None:
        self.known: dict[bytes, int] = {}

    def __missing(self, word: bytes) -> int:
        if len(self.known) >= MAX_WORDS:
            self.known.clear()
        value = self.known[word] = xxhash.xxh64_intdigest(word)
        return value

    def words(self, text: str) -> np.ndarray:
        data = text.encode().lower()  # bytes: only A-Z change
        known, parts, at = self.known, [], 0
        while at < len(data):
            end = at + (1 << 20)
            if end < len(data):
                cut = BLANK.search(data, end)
                end = cut.start() if cut else len(data)
            words = data[at:end].split()
            values = [known.get(w) for w in words]
            if None in values:
                values = [self.__missing(w) if v is None else v for w, v in zip(words, values)]
            parts.append(np.array(values, dtype=np.uint64))
            at = end
        return np.concatenate(parts) if parts else np.empty(0, np.uint64)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct 64-bit shingles; fewer words than a shingle needs are one shingle as a whole."""
        words = self.words(text)
        n = len(words)
        if n == 0:
            return words
        width = min(n, SHINGLE)
        sums = np.full(n - width + 1, n if n < SHINGLE else 0, dtype=np.uint64)
        for k in range(width):
            sums += _mix64(words[k:n - width + 1 + k]) * _POWERS[k]
        return np.unique(_mix64(sums))


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Band keys of each non-empty set, one row per set.

    Two permutations of the 2**32 slots make all coordinates: the first scatters the shingles, the second is used again and
    again, shifted circularly by one slot more for each coordinate, and the least image is the coordinate.
    """
    starts = np.cumsum([0, *map(len, sets[:-1])])
    scattered = _permute((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32) ^ np.uint32(SEED))
    signature = np.empty((bands * rows, len(sets)), dtype=np.uint32)
    for k in range(bands * rows):
        signature[k] = np.minimum.reduceat(_permute(scattered + np.uint32(k)), starts)
    keys = np.empty((len(sets), bands), dtype=np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, dtype=np.uint64)
        for k in range(b * rows, (b + 1) * rows):
            key = _mix64(key * np.uint64(0x9E3779B97F4A7C15) + signature[k])
        keys[:, b] = key
    return keys.view(np.int64)


def _permute(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit slots (shifts and odd factors); overwrites a fresh array."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def signatures(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, n_shingles, set_key, bands): the digest of the shingle set and its band keys; both null for an empty set."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                sets, weight, start = [], 0, at
                while at < batch.num_rows and weight < TOGETHER:
                    sets.append(shingler.shingles(batch.column(1)[at].as_py()))
                    weight += len(sets[-1])
                    at += 1
                full = [s for s in sets if len(s)]
                made = iter(band_keys(full, bands, rows)) if full else iter(())
                keys = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, at - start), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array(keys, pa.binary()), pa.array([next(made) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    names=["doc_id", "n_shingles", "set_key", "bands"])

    return _texts(docs).mapInArrow(run, "doc_id long, n_shingles long, set_key binary, bands array<long>")


def shingle_sets(docs: DataFrame) -> DataFrame:
    """(node, n, shingles) of each row with words."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = [shingler.shingles(t.as_py()).view(np.int64) for t in part.column(1)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))],
                    names=["node", "n", "shingles"])

    return _texts(docs).mapInArrow(run, "node long, n long, shingles array<long>").filter("n > 0")


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))


def near_groups(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row per input row.

    1. One pass over the texts gives each shingle set a digest and its band keys.  Rows with the same set are one node, named by
       its least id; from here on a group of copies is a single node, and the copies are only looked up again at the end.
    2. Nodes that share a band key with another node are candidates; their full sets are made once more and stored.
    3. A candidate of whose shingles more than a quarter occur in no other candidate cannot reach the similarity with anyone:
       an exact bound, which takes out nearly all chance meetings (shared passages) before any pair exists.
    4. In every bucket the least node is paired with the others, and pairs are verified on the full sets.  Then only nodes are
       left to be looked at that are in different components so far but were brought together by buckets (see ``crossing``).
    5. Components are contracted from the verified links.

    Texts without words have an empty set, are their own component and are kept, null and empty ones as well.  Rows that repeat an
    id are one document, which has the links of all its texts.  Rows without an id cannot be named: they are linked with nothing,
    have no component and are kept.  Only doc_id and text are read.  An empty table gives no rows.
    """
    sigs = stored(signatures(docs), "signatures")
    copies = sigs.filter("set_key is not null and doc_id is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_rows")).filter("n_rows > 1").drop("n_rows")
    joined = join_by_key(sigs, copies, ["set_key"], "doc_id", salts=16, how="left")
    node = F.when(F.col("set_key").isNotNull() & F.col("doc_id").isNotNull(), F.coalesce("first", "doc_id"))
    members = stored(joined.select("doc_id", "n_shingles", node.alias("node"), F.when(node == F.col("doc_id"), F.col("bands"))
                                   .alias("bands")), "near-members")
    found = links(docs, members)
    # one id with several texts ties the nodes of these texts
    named = members.filter("node is not null").select("doc_id", "node")
    least = named.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a < b").select("doc_id", "a")
    split_ids = join_by_key(named, least, ["doc_id"], "node").filter("a < node").select("a", F.col("node").alias("b")).distinct()
    comps = components(found.unionByName(split_ids))
    out = join_by_key(members.drop("bands"), comps, ["node"], "doc_id", salts=16, how="left")
    component = F.coalesce("component", "node", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"),
                      F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def links(docs: DataFrame, members: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes: enough of them to connect all that belongs together."""
    rows = members.filter("bands is not null").select("node", F.explode("bands").alias("key"))
    shared = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).filter("lo < hi").select("key")
    buckets = stored(rows.join(shared, "key").distinct(), "near-buckets")
    candidates = buckets.select(F.col("node").alias("doc_id")).distinct()
    texts = prefiltered(docs.select("doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long")), "doc_id", candidates)
    sets = stored(shingle_sets(texts.join(candidates, "doc_id", "left_semi")), "near-sets")
    alone = sets.select("node", F.explode("shingles").alias("s")).groupBy("s").agg(
        F.min("node").alias("node"), F.max("node").alias("other")).filter("node = other").groupBy("node").agg(
        F.count(F.lit(1)).alias("alone"))
    able = sets.select("node", "n").join(alone, "node", "left").filter(
        100 * (F.col("n") - F.coalesce("alone", F.lit(0))) >= PERCENT * F.col("n")).groupBy("node").agg(F.max("n").alias("n"))
    buckets = stored(buckets.join(able, "node"), "near-able")
    stars = buckets.groupBy("key").agg(F.min("node").alias("a"))
    pairs = buckets.join(stars, "key").filter("a < node").select("a", F.col("node").alias("b")).distinct()
    tried = stored(verified(pairs, sets), "near-stars")
    first = tried.filter("linked").select("a", "b")
    return stored(first.unionByName(crossing(able, sets, tried.select("a", "b"), components(first))), "near-links")


def crossing(able: DataFrame, sets: DataFrame, meetings: DataFrame, comps: DataFrame) -> DataFrame:
    """Verified links (a, b) between nodes that are in different components so far.

    Nodes that are connected by meetings in buckets form a family.  Most families are one component already and need nothing.  In
    the others every two nodes of different components are compared on their full sets, but no pair becomes a row: the nodes of a
    family are dealt into blocks, a task takes two blocks, counts all intersections as products of sparse rows, and gives back
    only links that join components, fewer than it has nodes.
    """
    families = components(meetings).withColumnRenamed("component", "family")
    placed = able.join(families, "node").join(comps, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = placed.groupBy("family").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.count(F.lit(1)).alias("m")) \
        .filter("x < y").select("family", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks"))
    rows = placed.join(mixed, "family").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.select("node", "family", "component", "block", "blocks").join(sets.select("node", "n", "shingles"), "node")
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "family", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "node", "component", "n", "shingles")
    return rows.groupBy("family", "i", "j").applyInPandas(_join_blocks, "a long, b long")


def _join_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    """Links between two blocks, or inside one, that join components."""
    pdf = pdf.sort_values("node")
    left = pdf if (one := pdf["i"].iloc[0] == pdf["j"].iloc[0]) else pdf[pdf["block"] == pdf["i"]]
    right = pdf if one else pdf[pdf["block"] == pdf["j"]]
    if left.empty or right.empty:
        return pd.DataFrame({"a": [], "b": []}, dtype="int64")
    common = _intersections(left["shingles"].tolist(), right["shingles"].tolist())
    union = left["n"].to_numpy()[:, None] + right["n"].to_numpy()[None, :] - common
    apart = left["component"].to_numpy()[:, None] != right["component"].to_numpy()[None, :]
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    out = []
    for i, j in zip(*np.nonzero(apart & (100 * common >= PERCENT * union))):
        x, y = root(left["component"].iloc[i]), root(right["component"].iloc[j])
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((left["node"].iloc[i], right["node"].iloc[j]))
    return pd.DataFrame(out, columns=["a", "b"], dtype="int64")


def _intersections(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of two lists of sets, in slices of the shingles that both lists hold."""
    shared = np.intersect1d(np.unique(np.concatenate(left)), np.unique(np.concatenate(right)))
    counts = np.zeros((len(left), len(right)), dtype=np.int64)
    places = [[np.sort(np.searchsorted(shared, s[np.isin(s, shared, assume_unique=True)])) for s in side] for side in (left, right)]
    for at in range(0, len(shared), SLICE):
        x, y = (np.zeros((len(side), SLICE), dtype=np.float32) for side in places)
        for matrix, side in ((x, places[0]), (y, places[1])):
            for row, place in enumerate(side):
                matrix[row, place[np.searchsorted(place, at):np.searchsorted(place, at + SLICE)] - at] = 1
        counts += (x @ y.T).astype(np.int64)
    return counts


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b, linked) by the exact Jaccard similarity of the full sets."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("s_b"))
    both = pairs.join(left, "a").join(right, "b")
    return both.select("a", "b", similar(F.col("n_a"), F.col("n_b"), F.size(F.array_intersect("s_a", "s_b"))).alias("linked"))


def similar(n_a: Column, n_b: Column, common: Column) -> Column:
    return 100 * common >= PERCENT * (n_a + n_b - common)


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: one document of each group of near duplicates, with their own columns only.

    Of rows that repeat id and text one stays, whatever their other columns are.
    """
    kept = near_groups(docs).filter("kept").select(F.col("doc_id").alias("_id")).distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    one = rows.join(kept, F.col("id").eqNullSafe(F.col("_id"))).dropDuplicates(["id", "mark"])
    return one.select(*[F.col("row")[c].alias(c) for c in docs.columns])
