"""Line dedup by a segment-partition edit join."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key, prefiltered, stored, text_or_empty

#: Lines of fewer characters (headings, list marks) take no part in the edit join; equal ones are removed on request (``short``).
MIN_CHARS = 20
#: Lines within so many edits of an earlier line are its repetition.  The partition below is the one for this threshold.
THRESHOLD = 1
#: Groups of more lines are split by a longer shared part before any pair is made: the part that may differ is cut in so many.
GROUP = 32
PARTS = 4


def _mark() -> Column:
    return F.xxhash64(text_or_empty()).alias("mark")


def _long(line: Column) -> Column:
    return F.length(F.trim(line)) >= MIN_CHARS


def occurrences(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, mark, pos, line, h) of every line that counts, with ``short`` all that have a word; h is a 128-bit digest of the line.

    ``mark`` is a hash of the whole text: it tells apart rows that share an id, or have none.
    """
    lines = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _mark(), F.posexplode(F.split(text_or_empty(), "\n", -1)).alias("pos", "line"))
    counts = _long(F.col("line")) | F.col("line").rlike(r"[^\x20\x09-\x0D]") if short else _long(F.col("line"))
    return lines.filter(counts).withColumn("h", F.unhex(F.md5("line")))


def _gap_key(line: Column, length: Column, a: Column, b: Column, longer: Column) -> Column:
    """Hash of a line without its gap: characters a to b of the shorter of two lines, one more of the longer."""
    behind = b + F.when(longer, 1).otherwise(0)
    return F.xxhash64(length, a, b, F.substring(line, F.lit(1), a), F.substring(line, behind + 1, F.length(line)))


def _halves(line: Column) -> Column:
    """Two segments, so one of them is whole in any line within one edit.

    A line is indexed by either half for its own length, and probes the partition of lines that are one character shorter: the
    left part from the start, the right part from the end.  Each entry is named by the gap, the half that may differ.
    """
    def entry(longer: bool, left: bool) -> Column:
        length = F.length(line) - int(longer)
        middle = F.floor(length / 2).cast("int")
        a, b = (F.lit(0), middle) if left else (middle, length)
        return F.struct(_gap_key(line, length, a, b, F.lit(longer)).alias("key"), F.lit(longer).alias("longer"), a.alias("a"), b.alias("b"))

    return F.array(*[entry(longer, left) for longer in (False, True) for left in (True, False)])


def _groups(entries: DataFrame) -> DataFrame:
    """Entries whose key holds two lines or more, one of which is indexed by it; with the size of the group."""
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("h").alias("lo"), F.max("h").alias("hi"),
                                       F.min("longer").alias("only_longer")).filter("lo <> hi and not only_longer").select("key", "n")
    return entries.join(sizes, "key")


def near_lines(lines: DataFrame, texts_of) -> DataFrame:
    """(h) of the distinct lines that lie within one edit of an earlier line.

    ``lines`` has h, first (document and position of the first occurrence) and entries; ``texts_of`` fetches the lines that are
    candidates.  Groups of up to GROUP lines give their pairs.  A larger group is split: each of its lines is entered again for
    the PARTS parts of its gap, so that two lines meet only if they share still more, down to a gap of one character, where all lines
    of one length are within one edit and only the earliest is paired with the others; insertions go on to an empty gap, which
    at most one line can index.  So no pairs are made beyond GROUP per line and level, and none are lost.
    """
    entries = lines.select("h", "first", F.explode("entries").alias("e")).select("h", "first", "e.*")
    members = stored(_groups(entries), "line-groups")
    texts = stored(texts_of(members.select("h", "first").distinct()), "line-texts")
    pairs = [_pairs(members.filter(F.col("n") <= GROUP))]
    large = members.filter(F.col("n") > GROUP)
    while not large.isEmpty():
        one = F.col("b") - F.col("a") == 1
        pairs += [_star(large.filter(one & ~F.col("longer")), F.col("first")), _star(large.filter("a = b"), F.col("longer"))]
        a, b = F.col("a"), F.col("b")
        width = b - a
        parts = F.least(width, F.lit(PARTS))
        border = lambda i: a + F.floor(width * i / parts).cast("int")
        split = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(border(i).alias("a"), border(i + 1).alias("b")))
        empty = F.array(*[F.struct(x.alias("a"), x.alias("b")) for x in (a, b)])
        gaps = F.when(one, empty).otherwise(split)
        finer = large.filter("a < b").select("h", "first", "longer", F.explode(gaps).alias("g")).select(
            "h", "first", "longer", "g.*").distinct().join(texts, "h")
        length = F.length("line") - F.when(F.col("longer"), 1).otherwise(0)
        key = _gap_key(F.col("line"), length, F.col("a"), F.col("b"), F.col("longer"))
        members = stored(_groups(finer.select("h", "first", "longer", "a", "b", key.alias("key"))), "line-groups")
        pairs.append(_pairs(members.filter(F.col("n") <= GROUP)))
        large = members.filter(F.col("n") > GROUP)
    return _verified(reduce(DataFrame.unionByName, pairs).distinct(), texts)


def _pairs(members: DataFrame) -> DataFrame:
    """(early, late) line digests that share a key of a small group."""
    index = members.filter("not longer").select("key", F.col("h").alias("h2"), F.col("first").alias("first2"))
    both = members.join(index, "key").filter((F.col("h") != F.col("h2")) & (F.col("longer") | (F.col("h") < F.col("h2"))))
    return _ordered(both)


def _ordered(both: DataFrame) -> DataFrame:
    here = F.struct("first", "h") < F.struct(F.col("first2").alias("first"), F.col("h2").alias("h"))
    return both.select(F.when(here, F.col("h")).otherwise(F.col("h2")).alias("early"),
                       F.when(here, F.col("h2")).otherwise(F.col("h")).alias("late"))


def _star(members: DataFrame, order: Column) -> DataFrame:
    """Pairs of the first line of each group with all others of the group."""
    hub = members.groupBy("key").agg(F.min(F.struct(order.alias("o"), "first", "h")).alias("hub")).select(
        "key", F.col("hub.h").alias("h2"), F.col("hub.first").alias("first2"))
    return _ordered(members.join(hub, "key").filter("h <> h2"))


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    both = pairs.join(texts.select(F.col("h").alias("early"), F.col("line").alias("x")), "early") \
        .join(texts.select(F.col("h").alias("late"), F.col("line").alias("y")), "late").select("late", "x", "y")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            ok = np.concatenate([np.empty(0, bool), *(within(x[i:i + 512], y[i:i + 512], THRESHOLD) for i in range(0, len(x), 512))])
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(ok, pa.bool_()))], names=["h"])

    return both.mapInArrow(run, "h binary").distinct()


def within(left: list[str], right: list[str], threshold: int) -> np.ndarray:
    """Whether each pair has an edit distance of at most ``threshold`` (up to 31).

    Banded bit-parallel distance: one 64-bit word per pair holds the differences down the band around the diagonal, and a column
    of the table is a few word operations for all pairs at once.  Characters above the band count as different, which can only
    raise distances that are above the threshold already.
    """
    order = sorted(range(len(left)), key=lambda i: len(left[i]))
    answer = np.zeros(len(left), dtype=bool)
    for at in range(0, len(order), 128):
        part = [i for i in order[at:at + 128] if abs(len(left[i]) - len(right[i])) <= threshold]
        if part:
            answer[part] = _band([left[i] for i in part], [right[i] for i in part], threshold)
    return answer


def _band(patterns: list[str], texts: list[str], k: int) -> np.ndarray:
    # a shared beginning changes no distance, and no line is shorter than the band then
    patterns, texts = ["\0" * k + p for p in patterns], ["\0" * k + t for t in texts]
    m, n = np.array([len(p) for p in patterns]), np.array([len(t) for t in texts])
    p, t = _codes(patterns, int(max(m.max(), n.max())) + 2 * k + 1), _codes(texts, int(n.max()) + 1)
    word, one = np.uint64, np.uint64(1)
    top = word(63)
    vp = np.full(len(m), (2**64 - 1) << (63 - k) & (2**64 - 1), dtype=word)
    vn = np.zeros(len(m), dtype=word)
    distance = np.full(len(m), k)
    for j in range(1, int(n.max()) + 1):
        match = np.zeros(len(m), dtype=word)
        for d in range(2 * k + 1):  # row j + k - d stands at bit 63 - d
            row = j + k - d
            if row >= 1:
                match |= (p[:, row - 1] == t[:, j - 1]).astype(word) << (top - word(d))
        d0 = (((match & vp) + vp) ^ vp) | match | vn
        hp = vn | ~(d0 | vp)
        hn = d0 & vp
        live = j <= n
        inside = j + k <= m
        at = np.clip(63 - (j + k - m), 0, 63).astype(word)  # the last row, once the band has passed it
        step = np.where(inside, ((d0 >> top) & one) == 0, (hp >> at) & one).astype(int) - np.where(inside, 0, (hn >> at) & one).astype(int)
        distance += np.where(live, step, 0)
        shifted = d0 >> one
        vp, vn = hn | ~(shifted | hp), shifted & hp
    return distance <= k


def _codes(lines: list[str], width: int) -> np.ndarray:
    out = np.zeros((len(lines), width), dtype=np.uint32)
    for i, line in enumerate(lines):
        out[i, :len(line)] = np.frombuffer(line.encode("utf-32-le"), dtype=np.uint32) + 1
    return out


def dropped_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, mark, drop): the positions of the lines that repeat an earlier line, for documents that have some.

    Earlier is by (doc_id, position, mark).  A line goes if the same line stands earlier, or if an earlier line is within one edit.
    """
    found = occurrences(docs, short)
    line = F.col("line")
    entries = F.when(_long(line), _halves(line)).otherwise(F.slice(_halves(line), 1, 0)) if short else _halves(line)
    lines = stored(found.select("h", F.struct("doc_id", "pos", "mark").alias("at"), entries.alias("entries")).groupBy("h").agg(
        F.min("at").alias("first"), F.count(F.lit(1)).alias("n"), F.first("entries").alias("entries")), "lines")

    def texts_of(wanted: DataFrame) -> DataFrame:
        at = wanted.select(F.col("h").alias("_line"), F.col("first.doc_id").alias("_doc"), F.col("first.pos").alias("_pos"))
        near = prefiltered(found.select("doc_id", "pos", "line", "h"), "h", wanted.select("h"))
        same = F.col("doc_id").eqNullSafe(F.col("_doc")) & (F.col("pos") == F.col("_pos")) & (F.col("h") == F.col("_line"))
        return near.join(at, same).select("h", "line").dropDuplicates(["h"])

    near = near_lines(lines, texts_of).withColumn("near", F.lit(True))
    hit = lines.join(near, "h", "left").filter("near or n > 1").select("h", "first", F.coalesce("near", F.lit(False)).alias("near"))
    hit = stored(hit, "line-hits")
    gone = join_by_key(found.select("doc_id", "mark", "pos", "h"), hit, ["h"], "doc_id", salts=16).filter(
        F.col("near") | ~F.struct("doc_id", "pos", "mark").eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "mark").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, short: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, text): every row with its text without the lines that repeat an earlier line.

    Lines are cut at \\n.  Lines of MIN_CHARS characters or more (blanks at the ends not counted) take part; with ``short``, as in the
    registered query and the pipeline, shorter lines that have a word go as well if the same line stands earlier.
    Null text is empty and has one empty line.  Rows that repeat an id, or have none (null sorts first), are told apart by a hash of
    their text: each loses its own repeated lines only.  Rows that repeat id and text are the same document and stay alike.  The
    order of lines is kept.  Only doc_id and text are read.  An empty table gives no rows.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return _without(rows, dropped_lines(docs, short)).select("doc_id", "n_lines", "n_dropped", "text")


def _without(docs: DataFrame, drops: DataFrame) -> DataFrame:
    """``docs`` (doc_id, text and no other column but ``row``) with the lines taken out of ``text``, and their number."""
    drops = drops.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("drop").alias("_drop"))
    joined = docs.withColumn("mark", _mark()).join(drops, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")), "left") \
        .withColumn("_lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    size = F.size("_lines")
    stay = F.array_except(F.sequence(F.lit(1), size), F.transform("_drop", lambda p: p + 1))
    text = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("_lines"), i)), "\n")
    return joined.withColumns({
        "n_lines": size.cast("long"), "n_dropped": F.coalesce(F.size("_drop"), F.lit(0)).cast("long"),
        "text": F.when(F.col("_drop").isNull(), F.col("text")).otherwise(text)}).withColumn(
        "n_dropped", F.greatest(F.col("n_dropped"), F.lit(0)))


def documents_without_repeats(docs: DataFrame, short: bool = False) -> DataFrame:
    """The rows of ``docs`` with their repeated lines removed (and ``n_chars`` in step).

    Documents of which nothing but blanks is left go: all they said stands elsewhere.  Documents that lost no line stay as they are.
    """
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = _without(rows, dropped_lines(docs, short)).filter((F.col("n_dropped") == 0) | (F.trim(F.regexp_replace("text", "\n", " ")) != ""))
    n_chars = F.when(F.col("n_dropped") > 0, F.length("text"))
    columns = {"text": F.col("text"), **({"n_chars": n_chars.otherwise(F.col("row")["n_chars"]).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})}
    return out.select(*[columns.get(c, F.col("row")[c]).alias(c) for c in docs.columns])
