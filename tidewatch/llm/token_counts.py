"""Edit-aware token counts: a segment tree of pre-tokens per document."""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.bpe import CHUNK, MAX_WORD_CHARS, MAX_WORDS, Coder, coder_source
from tidewatch.llm.common import text_or_empty

#: Pre-tokens of a leaf; a leaf that grows beyond four times as many makes the tree be built anew.
LEAF = 32
#: Pre-tokens before an edit that are encoded again.  A match looks at most three characters beyond its end, so four would do.
CONTEXT = 8
#: Characters behind a region that a match at its edge may look at.
SIGHT = 16


def merged_count(ranks: dict[bytes, int], word: bytes) -> int:
    """Tokens of one pre-token, by the definition: merge the pair of lowest rank, the leftmost first, until none is left.

    The work is quadratic in the length, so it is for short pre-tokens; there it costs less than new states of the transducer.
    """
    if word in ranks:
        return 1
    get, never = ranks.get, 1 << 60
    ends = list(range(len(word) + 1))
    pairs = [get(word[i:i + 2], never) for i in range(len(word) - 1)]
    while pairs:
        best = min(pairs)
        if best == never:
            break
        at = pairs.index(best)
        del pairs[at], ends[at + 1]
        if at < len(pairs):
            pairs[at] = get(word[ends[at]:ends[at + 2]], never)
        if at:
            pairs[at - 1] = get(word[ends[at - 1]:ends[at + 1]], never)
    return len(ends) - 1


class Counter:
    """Tokens per pre-token, remembered for frequent ones."""

    def __init__(self, coder: Coder):
        self.coder, self.known = coder, {}

    def of(self, word: str) -> int:
        n = self.known.get(word)
        if n is None:
            if len(word) > MAX_WORD_CHARS:
                return len(self.coder.fst.encode(word.encode()))
            n = merged_count(self.coder.fst.ranks, word.encode())
            if len(self.known) >= MAX_WORDS:
                self.known.clear()
            self.known[word] = n
        return n

    def total(self, words: list[str]) -> int:
        counts = list(map(self.known.get, words))
        if None in counts:
            counts = [self.of(w) if n is None else n for w, n in zip(words, counts)]
        return sum(counts)

    def pieces(self, text: str) -> Iterator[list[str]]:
        """Pre-tokens of a text, a leaf's worth at a time."""
        if len(text) <= CHUNK:
            found = self.coder.split.findall(text)
            for at in range(0, len(found), LEAF):
                yield found[at:at + LEAF]
            return
        matches = self.coder.split.finditer(text)
        while found := [m.group() for m in islice(matches, LEAF)]:
            yield found


class CountTree:
    """Token count of a text under edits.

    Leaves hold consecutive pre-tokens: their text, how many there are, and their tokens.  Above them, an implicit binary tree
    holds sums of characters and tokens.  An edit descends by characters to the leaf it falls in, steps back some pre-tokens,
    and encodes forward until a new boundary meets the start of an untouched leaf; from there on the old matches stand, for a
    match depends only on the text behind its start.  The new pre-tokens take the slots of the old ones and the sums above are
    updated.
    """

    def __init__(self, counter: Counter, leaves: list[tuple[str, int, int]]):
        self.counter, self.encoded = counter, 0
        self._fill(leaves)

    @classmethod
    def of_text(cls, counter: Counter, text: str) -> CountTree:
        return cls(counter, [("".join(p), len(p), counter.total(p)) for p in counter.pieces(text)])

    @classmethod
    def of_leaves(cls, counter: Counter, text: str, chars: list[int], words: list[int], tokens: list[int]) -> CountTree:
        """A stored tree: nothing is encoded."""
        leaves, at = [], 0
        for c, w, t in zip(chars, words, tokens):
            leaves.append((text[at:at + c], w, t))
            at += c
        return cls(counter, leaves)

    def _fill(self, leaves: list[tuple[str, int, int]]) -> None:
        self.leaves = leaves or [("", 0, 0)]
        self.size = 1 << max(0, (len(self.leaves) - 1).bit_length())
        self.chars, self.tokens = [0] * (2 * self.size), [0] * (2 * self.size)
        for i, (text, _, tokens) in enumerate(self.leaves):
            self.chars[self.size + i], self.tokens[self.size + i] = len(text), tokens
        for i in range(self.size - 1, 0, -1):
            self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
            self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]

    def total(self) -> int:
        return self.tokens[1]

    def text(self) -> str:
        return "".join(leaf[0] for leaf in self.leaves)

    def _leaf_at(self, position: int) -> tuple[int, int]:
        """The leaf that holds a character, and the position inside; the last leaf for the end of the text."""
        node = 1
        while node < self.size:
            node *= 2
            if position >= self.chars[node] and self.chars[node + 1]:
                position -= self.chars[node]
                node += 1
        return node - self.size, position

    def edit(self, position: int, delete: int, insert: str) -> None:
        """Replace ``delete`` characters from ``position`` on; both are cut to the text."""
        position = min(max(0, position), self.chars[1])
        delete = min(max(0, delete), self.chars[1] - position)
        if not delete and not insert:
            return
        first, start = self._leaf_at(position)
        last, end = self._leaf_at(position + delete)
        # a deletion that ends with a leaf leaves that leaf without the deleted part
        head, tail = self.leaves[first][0][:start], self.leaves[last][0][end:]
        context = 0
        while first and context < CONTEXT:
            first -= 1
            context += self.leaves[first][1]
            head = self.leaves[first][0] + head
        body, sure = head + insert + tail, len(head) + len(insert)
        slots = last + 1
        while True:
            words = self._match(body, sure, slots)
            if words is not None:
                break
            more = min(len(self.leaves), slots + max(1, slots - first))
            body += "".join(leaf[0] for leaf in self.leaves[slots:more])
            slots = more
        self._replace(first, slots, words)

    def _match(self, body: str, sure: int, slots: int) -> list[str] | None:
        """Pre-tokens of the region, if they end where the untouched leaves go on; else None."""
        following, k = "", slots
        while k < len(self.leaves) and len(following) < SIGHT:
            following += self.leaves[k][0]
            k += 1
        words = self.counter.coder.split.findall(body + following[:SIGHT])
        ends = list(accumulate(map(len, words), initial=0))
        n = bisect_left(ends, len(body))
        words, at = words[:n], ends[n]
        settled = at == len(body) and at >= sure
        # a match that runs over the edge needs more of the old leaves; at the end of the text there is no edge
        return words if settled or slots >= len(self.leaves) else None

    def _replace(self, first: int, slots: int, words: list[str]) -> None:
        self.encoded += len(words)
        count, per = slots - first, -(-len(words) // (slots - first)) if words else 0
        new = []
        for k in range(count):
            part = words[k * per:(k + 1) * per]
            new.append(("".join(part), len(part), self.counter.total(part)))
        self.leaves[first:slots] = new
        if per > 4 * LEAF:
            self._fill([leaf for text, _, _ in self.leaves for leaf in self._split(text)])
            return
        for i in range(first, slots):
            self.chars[self.size + i], self.tokens[self.size + i] = len(self.leaves[i][0]), self.leaves[i][2]
        low, high = (self.size + first) // 2, (self.size + slots - 1) // 2
        while low:
            for i in range(low, high + 1):
                self.chars[i] = self.chars[2 * i] + self.chars[2 * i + 1]
                self.tokens[i] = self.tokens[2 * i] + self.tokens[2 * i + 1]
            low, high = low // 2, high // 2

    def _split(self, text: str) -> list[tuple[str, int, int]]:
        return [("".join(p), len(p), self.counter.total(p)) for p in self.counter.pieces(text)]


TREE = "leaf_chars array<int>, leaf_words array<int>, leaf_tokens array<int>"


def build_trees(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, leaf_chars, leaf_words, leaf_tokens): the tree of each row, to be stored beside its text."""
    make = coder_source(docs.sparkSession, path, pattern)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(make())
        for batch in batches:
            trees = [CountTree.of_text(counter, t.as_py()) for t in batch.column(1)]
            yield _batch("doc_id long, n_tokens long, " + TREE, [batch.column(0), [t.total() for t in trees], *_leaves(trees)])

    return _texts(docs).mapInArrow(run, "doc_id long, n_tokens long, " + TREE)


def apply_edits(rows: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_encoded, text, leaf_*): new text, count and tree of rows with doc_id, text, edits and a stored tree.

    ``edits`` is an array of (pos, del, ins), done one after the other on the text as it is by then, in characters; a null array or
    a null part does nothing.  ``n_encoded`` is the number of pre-tokens that were encoded again.
    """
    make = coder_source(rows.sparkSession, path, pattern)
    schema = "doc_id long, n_tokens long, n_encoded long, text string, " + TREE

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(make())
        for batch in batches:
            trees = []
            for r in batch.to_pylist():
                trees.append(CountTree.of_leaves(counter, r["text"], r["leaf_chars"], r["leaf_words"], r["leaf_tokens"]))
                _edit(trees[-1], r["edits"])
            yield _batch(schema, [batch.column(0), [t.total() for t in trees], [t.encoded for t in trees], [t.text() for t in trees],
                                  *_leaves(trees)])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), "edits", "leaf_chars", "leaf_words",
                       "leaf_tokens").mapInArrow(run, schema)


def counts_under_edits(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """(doc_id, n_tokens, n_edited_tokens, n_encoded, edited_sha256): counts before and after the edits of each row, in one pass.

    The tree is built, then each edit touches only its surroundings.  Null and empty texts have no tokens before; edits may fill them.
    Repeated rows give repeated results, null ids stay null.  Reads doc_id, text and edits (see ``apply_edits``).
    """
    make = coder_source(docs.sparkSession, path, pattern)
    schema = "doc_id long, n_tokens long, n_edited_tokens long, n_encoded long, edited_sha256 string"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(make())
        for batch in batches:
            out = []
            for text, edits in zip(batch.column(1), batch.column(2)):
                tree = CountTree.of_text(counter, text.as_py())
                before = tree.total()
                _edit(tree, edits.as_py())
                out.append((before, tree.total(), tree.encoded, hashlib.sha256(tree.text().encode()).hexdigest()))
            yield _batch(schema, [batch.column(0), *([r[k] for r in out] for k in range(4))])

    return _texts(docs, "edits").mapInArrow(run, schema)


def derived_edits(seed: int = 1, n: int = 3) -> Column:
    """Edits that follow from the row itself: at hashed places some characters go, and a copied stretch of the text comes in."""
    size = F.length(text_or_empty()) + 1

    def number(k: int, what: str, below: Column) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.lit(k), F.lit(what), F.col("doc_id")), below.cast("long")).cast("int")

    return F.array(*[F.struct(
        number(k, "pos", size).alias("pos"), number(k, "del", F.lit(24)).alias("del"),
        F.substring(text_or_empty(), number(k, "from", size) + 1, number(k, "len", F.lit(24))).alias("ins")) for k in range(n)])


def _edit(tree: CountTree, edits: list[dict] | None) -> None:
    for e in edits or ():
        if e is not None:
            tree.edit(e["pos"] or 0, e["del"] or 0, e["ins"] or "")


def _texts(docs: DataFrame, *more: str) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), *more)


def _leaves(trees: list[CountTree]) -> list[list[list[int]]]:
    return [[[len(leaf[0]) if k == 0 else leaf[k] for leaf in t.leaves] for t in trees] for k in range(3)]


def _batch(schema: str, columns: list) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, (_, t) in zip(columns, fields)], names=[name for name, _ in fields])
