"""Character n-gram TF-IDF of log lines."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tidewatch.session import scratch_path

# Gram lengths and vocabulary size.
MIN_GRAM, MAX_GRAM, MAX_TERMS = 2, 4, 10_000
# Words end at any Unicode blank.
UNICODE_BLANKS = (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
# Rows a task hands over at once; characters it counts at once; (gram, document) pairs and grams it keeps before it sums or hands them over.
PART_ROWS, PART_CHARS, KEPT_PAIRS, KEPT_GRAMS = 1 << 18, 1 << 18, 1 << 21, 1 << 20
# A gram of up to four characters is one number; bits for the code of a character, few while they suffice.
PACKED, FEW_BITS, MANY_BITS = 4, 8, 16

Counted = tuple[np.ndarray, np.ndarray, np.ndarray]


def gram_counts(docs: DataFrame, doc_id: str = "id", text: str = "message", lo: int = MIN_GRAM, hi: int = MAX_GRAM, by_id: bool = True) -> DataFrame:
    """(id, gram, tf): n-grams inside space-padded, lower-cased words of the whole text.

    The grams of a row are counted where the row is; only rows that share an id (or have none) are brought together.
    Without ``by_id`` the documents of a task are summed up before they leave it: (gram, tf, df), in several rows for a gram.
    """
    once, shared = _by_use_of_id(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    joint = _row_grams(shared, lo, hi).groupBy("id", "gram").agg(F.sum("tf").alias("tf"))
    if by_id:
        return _row_grams(once, lo, hi).unionByName(joint)
    return _summed_grams(once, lo, hi).unionByName(joint.select("gram", "tf", F.lit(1).cast("bigint").alias("df")))


def _by_use_of_id(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows whose id no other row has, and the others.  Ids are counted once, without the texts."""
    path = scratch_path(docs.sparkSession, "shared-ids")
    docs.groupBy("id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("id").alias("_id")).write.parquet(path)
    shared = docs.sparkSession.read.schema(StructType([StructField("_id", docs.schema["id"].dataType)])).parquet(path)
    same = F.col("id").eqNullSafe(F.col("_id"))
    return docs.join(shared, same, "left_anti"), docs.join(shared, same, "left_semi")


class GramKeys:
    """Counts the grams of texts, each gram as one number.

    A character has a code, all blanks have the same one, and the codes of a gram stand side by side, the first one highest.  Codes
    are given to characters as they come; with ``terms``, in the order of characters and to theirs only, so that numbers sort as
    the grams do and grams with other characters are passed over.
    """

    def __init__(self, lo: int, hi: int, terms: Iterable[str] | None = None, part: int = PART_CHARS, few: int = FEW_BITS, many: int = MANY_BITS):
        self.lo, self.hi, self.part, self.many, self.grows = lo, hi, part, many, terms is None
        characters = sorted(set(" ").union(*terms)) if terms is not None else " "
        self.start(few if len(characters) < 1 << few else many, characters)

    @staticmethod
    def packs(lo: int, hi: int, terms: Iterable[str] = ()) -> bool:
        """Whether grams fit: no word is shorter than ``lo`` with its two blanks, and no gram is longer than a number holds."""
        return 2 <= lo <= 3 and hi <= PACKED and len(set(" ").union(*terms)) < 1 << MANY_BITS

    def start(self, bits: int, characters: Iterable[str] = " ") -> None:
        """Give codes anew."""
        points = [ord(c) for c in characters]
        self.kind, self.letters = (np.uint32 if bits * PACKED <= 32 else np.uint64), 1 << bits
        self.shifts = np.arange(bits * (PACKED - 1), -1, -bits).astype(self.kind)
        self.points = np.array([0, *points], np.uint32)  # by code; code 0 is no character
        self.code = np.zeros(0x110000, np.uint16)
        self.code[points] = np.arange(1, len(points) + 1)
        self.blank = self.code[0x20]
        self.code[list(UNICODE_BLANKS)] = self.blank

    def _codes(self, texts: list[str]) -> np.ndarray | None:
        """Codes of the texts, each between two blanks, and no characters behind them; None if there are too many characters."""
        points = np.frombuffer((" " + "  ".join(texts) + " ").encode("utf-32-le"), np.uint32)
        codes = np.zeros(len(points) + PACKED, np.uint16)
        codes[:len(points)] = self.code[points]
        if self.grows and not codes[:len(points)].all():
            new = np.unique(points[codes[:len(points)] == 0])
            if len(self.points) + len(new) > self.letters:
                return None
            self.code[new] = np.arange(len(self.points), len(self.points) + len(new))
            self.points = np.concatenate([self.points, new])
            codes[:len(points)] = self.code[points]
        return codes

    def _keys(self, codes: np.ndarray, ends: np.ndarray) -> Counted:
        """(ends, grams, counts) for rows that end at ``ends``; a gram belongs to the row it starts in."""
        n, lengths = int(ends[-1]), range(self.lo, self.hi + 1)
        keys, valid = np.empty((n, len(lengths)), self.kind), np.empty((n, len(lengths)), bool)
        some, full, wide = codes > 0, (codes > 0) & (codes != self.blank), codes.astype(self.kind)
        key, inner = wide[:n] << self.shifts[0], some[:n]
        for size in range(2, self.hi + 1):
            key = key | wide[size - 1:n + size - 1] << self.shifts[size - 1]
            inner = inner & full[size - 2:n + size - 2] if size > 2 else inner  # blanks are at the ends of a gram only
            if size in lengths:
                keys[:, size - self.lo] = key
                last = some[size - 1:n + size - 1]
                valid[:, size - self.lo] = inner & (last & (full[:n] | full[1:n + 1]) if size == 2 else last)
        keys = keys[valid]
        stops = np.cumsum([np.count_nonzero(valid[i:j]) for i, j in zip([0, *ends[:-1].tolist()], ends.tolist())])
        begin = 0
        for stop in stops.tolist():
            keys[begin:stop].sort()
            begin = stop
        first = np.ones(len(keys), bool)
        np.not_equal(keys[1:], keys[:-1], out=first[1:])
        first[stops[stops < len(keys)]] = True
        at = np.flatnonzero(first)
        return np.searchsorted(at, stops), keys[at], np.diff(at, append=len(keys))

    def _long(self, codes: np.ndarray, n: int) -> Counted:
        """The same for one long row, part by part."""
        parts = [self._keys(codes[i:i + self.part + PACKED], np.array([min(self.part, n - i)])) for i in range(0, n, self.part)]
        keys, which = np.unique(np.concatenate([k for _, k, _ in parts]), return_inverse=True)
        counts = np.bincount(which, np.concatenate([c for _, _, c in parts]), len(keys)).astype(np.int64)
        return np.array([len(keys)]), keys, counts

    def counted(self, texts: list[str | None]) -> Iterator[tuple[np.ndarray, Counted | None]]:
        """(rows, their grams) for some rows after another.

        None instead of grams: codes are given anew from here on, and these rows, if any, have too many characters for them.
        """
        rows: list[int] = []
        size = 0
        for row, text in enumerate(texts):
            if text:
                rows.append(row)
                size += len(text)
            if rows and (size >= self.part or row == len(texts) - 1):
                some = [texts[r] for r in rows]
                codes, n = self._codes(some), size + 2 * len(rows)
                if codes is None:
                    yield np.array([], int), None
                    self.start(self.many)
                    codes = self._codes(some)
                if codes is None:
                    yield np.array(rows), None
                elif len(rows) == 1 and n > self.part:
                    yield np.array(rows), self._long(codes, n)
                else:
                    yield np.array(rows), self._keys(codes, np.cumsum([len(t) + 2 for t in some]))
                rows, size = [], 0

    def keys_of(self, grams: list[str]) -> np.ndarray:
        """The numbers of grams whose characters have codes."""
        points = np.frombuffer("".join(g.ljust(PACKED, "\0") for g in grams).encode("utf-32-le"), np.uint32).reshape(-1, PACKED)
        inside = np.arange(PACKED) < np.array([len(g) for g in grams])[:, None]
        return (np.where(inside, self.code[points], 0).astype(self.kind) << self.shifts).sum(axis=1, dtype=self.kind)

    def grams(self, keys: np.ndarray) -> list[str]:
        """The grams of numbers."""
        codes = (keys[:, None] >> self.shifts) & self.kind(self.letters - 1)
        points, sizes = self.points[codes].tobytes().decode("utf-32-le"), (codes > 0).sum(axis=1).tolist()
        return [points[PACKED * i:PACKED * i + size] for i, size in enumerate(sizes)]


def _gram_counter(lo: int, hi: int, at: dict[str, int] | None = None) -> Callable[[str], dict]:
    """A function from a text to its grams and their counts; with ``at``, to the numbers of the grams that have one."""
    blanks = dict.fromkeys(UNICODE_BLANKS, " ")

    def count(text: str) -> dict:
        out: dict = {}
        for word, c in Counter(text.translate(blanks).split(" ")).items():
            p = f" {word} "
            for n in range(lo, hi + 1) if word else ():
                # A word shorter than the smallest length still counts once, whole.
                for i in range(max(len(p) - n + 1, int(n == lo))):
                    g = p[i:i + n] if at is None else at.get(p[i:i + n])
                    if g is not None:
                        out[g] = out.get(g, 0) + c
        return out

    return count


def _counted(texts: list[str | None], lo: int, hi: int, packed: GramKeys | None) -> Iterator[tuple[np.ndarray, np.ndarray, list[str], np.ndarray]]:
    """(row of each pair, number of its gram, grams by number, count) for some rows after another."""
    count = _gram_counter(lo, hi)
    for rows, found in packed.counted(texts) if packed else [(np.arange(len(texts)), None)]:
        if found is None:
            for row in rows.tolist():
                grams = count(texts[row] or "")
                yield np.full(len(grams), row), np.arange(len(grams)), list(grams), np.array([*grams.values()], np.int64)
        else:
            ends, keys, counts = found
            distinct, number = np.unique(keys, return_inverse=True)
            yield np.repeat(rows, np.diff(ends, prepend=0)), number, packed.grams(distinct), counts


def _lowered(docs: DataFrame) -> DataFrame:
    return docs.select("id", F.lower("text").alias("text")).where(F.col("text").isNotNull())


def _in_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in small batches, so that few texts are there a second time as Python's."""
    for batch in batches:
        ends, begin = np.cumsum(pc.binary_length(batch.column("text")).to_numpy(zero_copy_only=False).astype(int)), 0
        while begin < batch.num_rows:
            end = int(np.searchsorted(ends, (ends[begin - 1] if begin else 0) + PART_CHARS)) + 1
            yield batch.slice(begin, end - begin)
            begin = end
    pa.default_memory_pool().release_unused()


def _row_grams(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """(id, gram, tf) of every row by itself."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = GramKeys(lo, hi) if GramKeys.packs(lo, hi) else None
        for batch in _in_parts(batches):
            for rows, number, grams, tf in _counted(batch.column("text").to_pylist(), lo, hi, packed):
                ids, names = batch.column("id"), pa.array(grams, pa.string())
                for i in range(0, len(rows), PART_ROWS):
                    part = slice(i, i + PART_ROWS)
                    yield pa.record_batch([ids.take(pa.array(rows[part])), names.take(pa.array(number[part])), pa.array(tf[part], pa.int64())],
                                          ["id", "gram", "tf"])

    kind = docs.schema["id"].dataType.simpleString()
    return _lowered(docs).mapInArrow(run, f"id {kind}, gram string, tf bigint")


def _summed_grams(docs: DataFrame, lo: int, hi: int) -> DataFrame:
    """(gram, tf, df) over the rows of a task, each a document; a gram comes again where the task could not keep all of them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = GramKeys(lo, hi) if GramKeys.packs(lo, hi) else None
        sums = _Sums()

        def handed_over(grams: list[str], tf: np.ndarray, df: np.ndarray) -> Iterator[pa.RecordBatch]:
            for i in range(0, len(grams), PART_ROWS):
                part = slice(i, i + PART_ROWS)
                yield pa.record_batch([pa.array(grams[part], pa.string()), pa.array(tf[part], pa.int64()), pa.array(df[part], pa.int64())],
                                      ["gram", "tf", "df"])

        def emptied() -> Iterator[pa.RecordBatch]:
            keys, tf, df = sums.taken()
            yield from handed_over(packed.grams(keys), tf, df)

        count = _gram_counter(lo, hi)
        for batch in _in_parts(batches):
            texts = batch.column("text").to_pylist()
            for rows, found in packed.counted(texts) if packed else [(np.arange(len(texts)), None)]:
                if found is not None:
                    sums.add(*found[1:])
                    if sums.size() > KEPT_GRAMS:
                        yield from emptied()
                    continue
                if packed:  # the codes end here
                    yield from emptied()
                for row in rows.tolist():
                    grams = count(texts[row] or "")
                    yield from handed_over(list(grams), np.array([*grams.values()], np.int64), np.ones(len(grams), np.int64))
        if packed:
            yield from emptied()

    return _lowered(docs).mapInArrow(run, "gram string, tf bigint, df bigint")


class _Sums:
    """Occurrences and documents by gram number; pairs are summed up when there are many of them."""

    def __init__(self) -> None:
        self.sums, self.pairs, self.waiting = None, [], 0

    def add(self, keys: np.ndarray, tf: np.ndarray) -> None:
        self.pairs.append((keys, tf))
        self.waiting += len(keys)
        if self.waiting > KEPT_PAIRS:
            self._sum_up()

    def size(self) -> int:
        return self.sums.num_rows if self.sums else 0

    def _sum_up(self) -> None:
        names = ["key", "tf", "df"]
        parts = [pa.table([keys, tf, np.ones(len(keys), np.int64)], names) for keys, tf in self.pairs]
        if self.sums:
            parts.append(self.sums)
        if parts:
            summed = pa.concat_tables(parts).group_by("key", use_threads=False).aggregate([("tf", "sum"), ("df", "sum")])
            self.sums = summed.select(["key", "tf_sum", "df_sum"]).rename_columns(names)
        self.pairs, self.waiting = [], 0

    def taken(self) -> Counted:
        self._sum_up()
        out = tuple(self.sums.column(i).to_numpy() for i in range(3)) if self.sums else (np.zeros(0, np.uint32), *[np.zeros(0, np.int64)] * 2)
        self.sums = None
        return out


def vocabulary(counts: DataFrame, n_docs: DataFrame, max_terms: int = MAX_TERMS) -> DataFrame:
    """The most frequent grams with corpus frequency, document frequency and smoothed idf.

    ``n_docs`` is one row with column ``n_docs``.  ``counts`` may come summed up by task.
    """
    df = F.sum("df") if "df" in counts.columns else F.count(F.lit(1))
    terms = counts.groupBy("gram").agg(F.sum("tf").alias("total"), df.alias("df"))
    top = terms.orderBy(F.desc("total"), "gram").limit(max_terms)
    out = top.join(F.broadcast(n_docs))  # one row
    return out.select("gram", "total", "df", (F.ln((1 + F.col("n_docs")) / (1 + F.col("df"))) + 1).alias("idf"))


def tfidf(counts: DataFrame, vocab: DataFrame) -> DataFrame:
    """(id, gram, weight): (1 + ln tf) * idf, scaled to unit length per document.

    The vocabulary has a fixed largest size, which bounds the broadcast and the
    terms per document.
    """
    w = counts.join(F.broadcast(vocab.select("gram", "idf")), "gram")
    w = w.withColumn("weight", (1 + F.ln("tf")) * F.col("idf"))
    norm = F.sqrt(F.sum(F.col("weight") * F.col("weight")).over(Window.partitionBy("id")))
    return w.select("id", "gram", (F.col("weight") / norm).alias("weight"))


def sparse_rows(weights: DataFrame, numbered: DataFrame) -> DataFrame:
    """(id, indices, values) per document; ``numbered`` maps gram to ``idx``."""
    w = weights.join(F.broadcast(numbered), "gram").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "weight"))).alias("t"))
    return w.select("id", F.col("t.idx").alias("indices"), F.col("t.weight").alias("values"))


def _term_counter(lo: int, hi: int, at: dict[str, int]) -> Callable[[list[str | None]], Iterator[tuple[np.ndarray, ...]]]:
    """A function from texts to (rows, ends, indices, counts) for some rows after another: the terms of a row in the order of their numbers."""
    if not GramKeys.packs(lo, hi, at):
        count = _gram_counter(lo, hi, at)

        def one_by_one(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
            for row, text in enumerate(texts):
                found = sorted(count(text or "").items())
                yield (np.array([row]), np.array([len(found)]), *np.array(found, np.int64).reshape(-1, 2).T)

        return one_by_one
    packed = GramKeys(lo, hi, at)
    names = sorted(g for g in at if lo <= len(g) <= hi)
    keys, indices = packed.keys_of(names), np.array([at[g] for g in names], np.int64)
    in_order = bool((np.diff(indices) > 0).all())

    def count_all(texts: list[str | None]) -> Iterator[tuple[np.ndarray, ...]]:
        for rows, (ends, found, counts) in packed.counted(texts) if names else ():
            place = np.searchsorted(keys, found)
            place[place == len(keys)] = 0
            known = keys[place] == found
            ends = np.concatenate([[0], np.cumsum(known)])[ends]
            found, counts = indices[place[known]], counts[known]
            if not in_order:
                order = np.lexsort((found, np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))))
                found, counts = found[order], counts[order]
            yield rows, ends, found, counts

    return count_all


def document_terms(docs: DataFrame, numbered: DataFrame, doc_id: str = "id", text: str = "message", lo: int = MIN_GRAM,
                   hi: int = MAX_GRAM) -> DataFrame:
    """(id, n, terms): per document the numbers of its n vocabulary terms in order, and how often each occurs.

    ``numbered`` maps gram to ``idx``; the vocabulary has a fixed largest size.  Documents without a term are left out.  The
    result is stored, as small as the texts: weights follow from it by ``sparse_weights`` wherever they are used.  Both lists
    are packed (``_packed_lists``), as columns of lists take longer to write and read than the grams take to count.
    """
    terms = docs.sparkSession.sparkContext.broadcast({r.gram: r.idx for r in numbered.select("gram", "idx").collect()})
    once, shared = _by_use_of_id(docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")))
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _term_counter(lo, hi, terms.value)
        for batch in _in_parts(batches):
            for rows, ends, indices, counts in count(batch.column("text").to_pylist()):
                some = np.diff(ends, prepend=0) > 0
                yield pa.record_batch([batch.column("id").take(pa.array(rows[some])), *_packed_lists(ends[some], indices, counts)], ["id", "n", "terms"])

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("indices"), batch.column("counts")
            for i in range(batch.num_rows):
                indices, counts = (x[i].values.to_numpy() for x in lists)
                yield pa.record_batch([batch.column("id").slice(i, 1), *_packed_lists(np.array([len(indices)]), indices, counts)], ["id", "n", "terms"])

    stored = f"id {kind}, n int, terms binary"

    def per_row(some: DataFrame) -> DataFrame:
        return _lowered(some).mapInArrow(run, stored)

    cells = _term_cells(per_row(shared)).groupBy("id", "idx").agg(F.sum("tf").alias("tf"))
    joint = cells.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("idx", "tf"))).alias("t"))
    joint = joint.select("id", F.col("t.idx").alias("indices"), F.col("t.tf").alias("counts"))
    out = per_row(once).unionByName(joint.mapInArrow(packed, stored))
    path = scratch_path(docs.sparkSession, "document-terms")
    out.write.option("compression", "none").parquet(path)  # packed already
    return docs.sparkSession.read.schema(out.schema).parquet(path)


def _packed_lists(ends: np.ndarray, indices: np.ndarray, counts: np.ndarray) -> list[pa.Array]:
    """Lengths and bytes: the steps from a term's number to the next one, and the counts, byte by byte of four, compressed."""
    steps = np.diff(indices, prepend=0)
    begins = np.concatenate([[0], ends]).astype(int)
    steps[begins[:-1]] = indices[begins[:-1]]
    planes = np.concatenate([x.astype("<u4").view(np.uint8).reshape(-1, 4).T for x in (steps, counts)])
    packer = pa.Codec("zstd", 1)
    packed = [packer.compress(planes[:, i:j].tobytes(), asbytes=True) for i, j in zip(begins.tolist(), begins[1:].tolist())]
    return [pa.array(np.diff(begins), pa.int32()), pa.array(packed, pa.binary())]


def _unpacked_lists(batch: pa.RecordBatch) -> Iterator[tuple[slice, np.ndarray, np.ndarray, np.ndarray]]:
    """(rows, lengths, indices, counts) for some rows after another."""
    sizes, packed = batch.column("n").to_numpy().astype(int), batch.column("terms")
    packer, begin = pa.Codec("zstd"), 0
    while begin < len(sizes):
        end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:begin + PART_ROWS]), PART_ROWS, "right")))
        lengths = sizes[begin:end]
        stops = np.cumsum(lengths)
        planes = np.empty((8, int(stops[-1])), np.uint8)
        for i, j, some in zip((stops - lengths).tolist(), stops.tolist(), packed.slice(begin, end - begin).to_pylist()):
            planes[:, i:j] = np.frombuffer(packer.decompress(some, decompressed_size=8 * (j - i), asbytes=True), np.uint8).reshape(8, -1)
        steps, counts = (sum(planes[k + i].astype(int) << 8 * i for i in range(4) if not i or planes[k + i].any()) for k in (0, 4))
        indices, first = np.cumsum(steps), stops - lengths
        indices -= np.repeat(indices[first] - steps[first], lengths)  # no row is without a term
        yield slice(begin, end), lengths, indices, counts
        begin = end


def _term_cells(terms: DataFrame) -> DataFrame:
    """(id, idx, tf): a row for each term of each row."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, lengths, indices, counts in _unpacked_lists(batch):
                ids = batch.column("id").take(pa.array(np.repeat(np.arange(rows.start, rows.stop), lengths)))
                yield pa.record_batch([ids, pa.array(indices, pa.int32()), pa.array(counts, pa.int64())], ["id", "idx", "tf"])

    return terms.mapInArrow(run, f"id {terms.schema['id'].dataType.simpleString()}, idx int, tf bigint")


def sparse_weights(terms: DataFrame, vocab: DataFrame, numbered: DataFrame, then: Callable | None = None, schema: str = "") -> DataFrame:
    """(id, indices, values): the weights of ``tfidf`` over the rows of ``document_terms``, as ``sparse_rows`` lays them out.

    Other columns of ``terms`` stay.  ``then`` gets the weighed batches of a task where they are and makes rows of ``schema`` from them.
    """
    known = vocab.join(numbered, "gram").select("idx", "idf").collect()  # the vocabulary has a fixed largest size
    table = np.zeros(max((r.idx for r in known), default=-1) + 1)
    for r in known:
        table[r.idx] = r.idf
    idf = terms.sparkSession.sparkContext.broadcast(table)

    others = [f for f in terms.schema.fields if f.name not in ("n", "terms")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, lengths, at, tf in _unpacked_lists(batch):
                x = (1 + np.log(tf)) * idf.value[at]
                stops = np.cumsum(lengths)
                norm = np.sqrt(np.add.reduceat(x * x, stops - lengths))
                ends = pa.array(np.concatenate([[0], stops]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (at.astype(np.int32), x / np.repeat(norm, lengths))]
                kept = [batch.column(f.name).slice(rows.start, len(lengths)) for f in others]
                yield pa.record_batch([*kept, *lists], [*(f.name for f in others), "indices", "values"])

    rows = terms.select(*[f.name for f in others], "n", "terms")
    if then is not None:
        return rows.mapInArrow(lambda batches: then(run(batches)), schema)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in others)
    return rows.mapInArrow(run, f"{kinds}, indices array<int>, values array<double>")
