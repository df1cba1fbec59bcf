"""Spelling variants of words, found with an index of variable-length grams."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

MIN_CHARS = 5
MIN_COUNT = 3
#: One run in so many, chosen by a hash of document and run, loses a code point.
TYPO_EVERY = 97
#: Shortest and longest gram.
Q_MIN, Q_MAX = 2, 4
#: A gram that stands at more places of the vocabulary is extended, up to Q_MAX.
FREQUENT = 32
#: Bound of the dictionary: with more places than this times FREQUENT the limit rises, so that it never holds more grams a length.
MAX_GRAMS = 100_000
#: Distinct words a task counts before it hands them on.
HELD_WORDS = 400_000
#: ``[A-Za-zÀ-ÿ]`` as UTF-8 bytes.
RUN = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\xbf])+")
BEGIN, END = "\x01", "\x02"


def _count(min_chars: int, every: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                body = text.as_py().lower()
                counts = Counter(RUN.findall(body) if len(body) < 1 << 20 else (m.group() for m in RUN.finditer(body)))
                seed = zlib.crc32(b":" if ident is None else b"%d:" % ident)
                for word, n in counts.items():
                    if len(word) >= min_chars:  # a run only gets shorter
                        h = zlib.crc32(word, seed)
                        if h % every == 0:
                            run_ = word.decode()
                            k = h % len(run_)
                            word = (run_[:k] + run_[k + 1:]).encode()
                        held[word] += n
            if len(held) >= HELD_WORDS:
                yield _table(held)
                held = Counter()
        yield _table(held)

    def _table(counts: Counter) -> pa.RecordBatch:
        words = pa.array(list(counts), pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([words, pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def vocabulary(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY) -> DataFrame:
    """(word, n): runs of letters with A-Z lower-cased, after the planted typos, with at least so many code points and occurrences.

    Tasks count their own words first, in tables of bounded size.
    """
    rows = docs.select(F.col("doc_id").cast("long"), text_or_empty().cast("binary"))
    return rows.mapInArrow(_count(min_chars, typo_every), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")) \
        .filter((F.col("n") >= min_count) & (F.length("word") >= min_chars))


def gram_dictionary(words: DataFrame, pad: int, q_max: int = Q_MAX) -> list[str]:
    """The grams of Q_MIN to ``q_max - 1`` characters that are frequent: those that get extended.

    Frequency only falls as a gram grows, so a gram is frequent only if its beginnings are.  The limit is FREQUENT places, or
    more in a large vocabulary, so that the dictionary has at most MAX_GRAMS grams of a length whatever the input.
    """
    padded = F.concat(F.lit(BEGIN * pad), "word", F.lit(END * pad))
    places = F.explode(F.expr(f"flatten(transform(sequence({Q_MIN}, {q_max - 1}), q -> "
                              "transform(sequence(1, length(w) - q + 1), p -> substring(w, p, q))))"))
    total = words.agg(F.sum(F.length("word") + 2 * pad)).first()[0] or 0
    limit = max(FREQUENT, total // MAX_GRAMS)
    counts = words.select(padded.alias("w")).select(places.alias("g")).groupBy("g").count().filter(F.col("count") > limit)
    return [r.g for r in counts.select("g").collect()]


def _decompose(frequent: set[str], pad: int, q_max: int):
    """Per word: its grams with their places, and the most grams one edit can affect.

    The gram at a place is the shortest one that is not frequent, of ``q_max`` characters at most.  It depends on its own
    characters alone, so an edit affects just the grams that cover its place.
    """

    def grams(text: str) -> list[str]:
        out = []
        for p in range(len(text) - Q_MIN + 1):
            q = Q_MIN
            while q < q_max and p + q < len(text) and text[p:p + q] in frequent:
                q += 1
            out.append(text[p:p + q])
        return out

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, affected, sizes = [], [], []
            for word in batch.column(1).to_pylist():
                text = BEGIN * pad + word + END * pad
                own = grams(text)
                change = [0] * (len(text) + 1)
                for p, g in enumerate(own):
                    change[p] += 1
                    change[p + len(g)] -= 1
                covers, most = 0, 0
                for i in range(len(text) - pad):
                    covers += change[i]
                    if i >= pad:
                        most = max(most, covers)
                found.append(own)
                affected.append(most)
                sizes.append(len(word))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string())), pa.array(affected, pa.int32()),
                                              pa.array(sizes, pa.int32())], names=["id", "grams", "affected", "size"])

    return run


def near_words(words: DataFrame, min_chars: int = MIN_CHARS, q_max: int = Q_MAX) -> DataFrame:
    """(word, n, near, near_n): every two words one inserted, deleted or replaced code point apart, in both directions.

    ``words`` has (id long, word, n).  One edit affects at most ``affected`` grams of a word, so of any ``affected + 1`` of its
    grams one stands unchanged in the other word: at the same place, or, if a character before it is gone, one place earlier.
    Each word takes its rarest ones.

    * Words of equal length differ by a replacement, which moves nothing; both lists use one order of grams, rarest first, so the
      rarest common gram is among the first ``affected + 1`` of both, and only those lists are merged.
    * A word and one shorter by a character: the rarest grams of the longer word look into the list of all grams of the
      shorter words, at their own place and one earlier.

    Lists are keyed by gram, place and length.  What meets in a list must agree in all but two letters (a bit mask) before
    the edit distance is computed.
    """
    pad = max(1, -(-(q_max + 2 - min_chars) // 2))  # then a word always has more grams than one edit affects
    run = _decompose(set(gram_dictionary(words, pad, q_max)), pad, q_max)
    parts = words.select("id", "word").mapInArrow(run, "id long, grams array<string>, affected int, size int")
    places = parts.select("id", "affected", "size", F.posexplode("grams").alias("p", "g")) \
        .withColumn("key", F.xxhash64("g", "p", "size"))
    places = stored(places, "spelling-grams")
    counts = places.groupBy("key").agg(F.count(F.lit(1)).alias("c"))
    ordered = places.join(counts, "key").groupBy("id").agg(
        F.min("affected").alias("affected"), F.sort_array(F.collect_list(F.struct("c", "key", "g", "p", "size"))).alias("all"))
    rarest = stored(ordered.select("id", F.explode(F.expr("slice(all, 1, affected + 1)")).alias("e"))
                    .select("id", "e.key", "e.g", "e.p", "e.size"), "spelling-rarest")
    letters = F.expr("aggregate(transform(split(word, ''), c -> shiftleft(1L, pmod(ascii(c), 64))), 0L, (a, b) -> a | b)")
    facts = stored(words.select("id", "word", "n", letters.alias("mask")), "spelling-words")

    def side(rows: DataFrame, name: str) -> DataFrame:
        return rows.join(facts, "id").select("key", F.col("word").alias(name), F.col("n").alias(f"{name}_n"), F.col("mask").alias(f"{name}_mask"))

    close = (F.bit_count(F.col("a_mask").bitwiseXOR(F.col("b_mask"))) <= 2) & (F.levenshtein("a", "b", 1) == 1)
    same_place = rarest.select("id", "key")
    swapped = side(same_place, "a").join(side(same_place, "b"), "key").filter(F.col("a") < F.col("b")).filter(close)
    earlier = F.explode(F.array(F.col("p"), F.col("p") - 1)).alias("p")
    probes = rarest.select("id", "g", earlier, (F.col("size") - 1).alias("size")).filter("p >= 0") \
        .select("id", F.xxhash64("g", "p", "size").alias("key"))
    dropped = side(probes, "a").join(side(places.select("id", "key"), "b"), "key").filter(close)
    pairs = swapped.unionByName(dropped).select("a", "a_n", "b", "b_n").distinct()
    both = F.explode(F.array(F.struct(F.col("a").alias("word"), F.col("a_n").alias("n"), F.col("b").alias("near"), F.col("b_n").alias("near_n")),
                             F.struct(F.col("b").alias("word"), F.col("b_n").alias("n"), F.col("a").alias("near"), F.col("a_n").alias("near_n"))))
    return pairs.select(both.alias("e")).select("e.*")


def spelling_forms(docs: DataFrame, min_chars: int = MIN_CHARS, min_count: int = MIN_COUNT, typo_every: int = TYPO_EVERY,
                   q_max: int = Q_MAX) -> DataFrame:
    """(word, form, root, n, n_near, form_n): each word of the vocabulary with the more frequent word it is a variant of.

    ``form`` is the near word of largest ``n`` (ties: the smallest in code-point order) if that is at least twice the word's
    own, else null; ``root`` is what following forms ends at.  Counts at least double along the way, so a chain is never longer
    than the logarithm of the largest count, and jumping over forms takes the logarithm of that many joins.

    Null texts have no words, a null id counts as an empty one in the hash, rows that repeat an id are counted each.  Only
    doc_id and text are read.  An empty table gives an empty result.
    """
    words = vocabulary(docs, min_chars, min_count, typo_every)
    words = stored(words.withColumn("id", F.monotonically_increasing_id()), "spelling-vocabulary")
    near = stored(near_words(words, min_chars, q_max), "spelling-near")
    tops = near.groupBy("word").agg(F.max("near_n").alias("near_n"), F.count(F.lit(1)).alias("n_near"))
    firsts = near.groupBy("word", "near_n").agg(F.min("near").alias("near"))
    found = tops.join(firsts, ["word", "near_n"])
    out = words.drop("id").join(found, "word", "left")
    form = F.when(F.col("near_n") >= 2 * F.col("n"), F.col("near"))
    out = stored(out.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("form"),
                            F.when(form.isNotNull(), F.col("near_n")).alias("form_n")), "spelling-forms")
    links = out.filter("form is not null").select("word", F.col("form").alias("root"))
    while True:
        links = stored(links, "spelling-links")
        over = links.select(F.col("word").alias("_word"), F.col("root").alias("_root"))
        joined = links.join(over, F.col("root") == F.col("_word"), "left")
        if joined.filter("_root is not null").isEmpty():
            break
        links = joined.select("word", F.coalesce("_root", "root").alias("root"))
    return out.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
