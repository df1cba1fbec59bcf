"""Byte-level BPE by a lazily determinised transducer, and streaming decoding."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from itertools import islice

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import text_or_empty

#: Bounds of the per-process memories: transducer states, remembered pre-tokens and the length of one that is remembered.
MAX_STATES = 200_000
MAX_WORDS = 300_000
MAX_WORD_CHARS = 64
#: Pre-tokens of a text that are in memory at a time.
CHUNK = 65_536
ROOT = 0


def read_ranks(path: str) -> dict[bytes, int]:
    """The rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Transducer:
    """Encodes bytes to token ids in one pass.

    A sequence of tokens is the encoding of its bytes exactly if every token encodes to itself and every two neighbours encode
    to themselves: merges never cross a boundary then.  So the encoder is a nondeterministic transducer that reads a path of
    the token trie and, at its end, may finish the token if it fits the token before.  Determinising it keeps all readings of
    the bytes so far: for each a last finished token, a trie node and the tokens not written yet.  What all readings share is
    written at once; a reading dies when its path leaves the trie, so the lookahead is bounded by the longest token.  States
    and transitions are made when first met, and forgotten together when there are too many.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.children: list[dict[int, int]] = [{}]
        self.ends: list[int] = [-1]
        for token, rank in ranks.items():
            node = ROOT
            for byte in token:
                step = self.children[node].get(byte)
                if step is None:
                    step = self.children[node][byte] = len(self.children)
                    self.children.append({})
                    self.ends.append(-1)
                node = step
            self.ends[node] = rank
        self.fits: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = ((-1, ROOT, ()),)
        self.number = {start: 0}
        self.readings = [start]
        self.arcs: list[dict[int, tuple[int, tuple[int, ...]]]] = [{}]

    def stays(self, left: bytes, right: bytes) -> bool:
        """The definition, for one token or two: merge the pair of lowest rank, the leftmost first, until none is left.

        True if no merge crosses from the left part to the right one and both end as single tokens; an empty left part asks
        whether the right one is reached by merges at all.
        """
        word, get, never = left + right, self.ranks.get, 1 << 60
        parts = [word[i:i + 1] for i in range(len(word))]
        ranks = [get(x + y, never) for x, y in zip(parts, parts[1:])]
        border = len(left)
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            if at + 1 == border:
                return False
            border -= at + 1 < border
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = get(parts[at] + parts[at + 1], never)
            if at:
                ranks[at - 1] = get(parts[at - 1] + parts[at], never)
        return len(parts) == (2 if left else 1)

    def follows(self, last: int, token: int) -> bool:
        """Whether a token may stand behind another one, or (last < 0) at the beginning."""
        known = self.fits.get((last, token))
        if known is None:
            if len(self.fits) > 4 * MAX_STATES:
                self.fits.clear()
            known = self.fits[last, token] = self.stays(self.token[last] if last >= 0 else b"", self.token[token])
        return known

    def arc(self, state: int, byte: int) -> tuple[int, tuple[int, ...]]:
        """Make the transition of a state on a byte: next state, and the tokens that are certain now."""
        after = []
        for last, node, waiting in self.readings[state]:
            step = self.children[node].get(byte)
            if step is None:
                continue
            if self.children[step]:
                after.append((last, step, waiting))
            token = self.ends[step]
            if token >= 0 and self.follows(last, token):
                after.append((token, ROOT, (*waiting, token)))
        certain = 0
        shortest = min(len(w) for _, _, w in after)
        while certain < shortest and len({w[certain] for _, _, w in after}) == 1:
            certain += 1
        out = after[0][2][:certain]
        new = tuple(sorted((last, node, w[certain:]) for last, node, w in after))
        if new not in self.number:
            self.number[new] = len(self.readings)
            self.readings.append(new)
            self.arcs.append({})
        made = self.arcs[state][byte] = (self.number[new], out)
        return made

    def encode(self, word: bytes) -> list[int]:
        """Token ids of one pre-token.  A pre-token that is itself a token is that token, reachable by merges or not."""
        whole = self.ranks.get(word)
        if whole is not None:
            return [whole]
        if len(self.readings) > MAX_STATES:
            self.clear()
        out: list[int] = []
        state, arcs = 0, self.arcs
        for byte in word:
            state, tokens = arcs[state].get(byte) or self.arc(state, byte)
            if tokens:
                out += tokens
        out += next((w for _, node, w in self.readings[state] if node == ROOT), ())
        return out


class Utf8Stream:
    """Turns byte pieces into text as soon as code points are complete; its state is the bytes of an unfinished one."""

    def __init__(self, errors: str = "strict"):
        self.errors, self.pending = errors, b""

    def feed(self, piece: bytes) -> str:
        data = self.pending + piece
        whole = len(data) - self._open(data)
        self.pending = data[whole:]
        return data[:whole].decode("utf-8", self.errors)

    def end(self) -> str:
        data, self.pending = self.pending, b""
        return data.decode("utf-8", self.errors)

    @staticmethod
    def _open(data: bytes) -> int:
        """Length of the unfinished code point at the end: a lead byte that still waits for continuation bytes."""
        for back in range(1, min(3, len(data)) + 1):
            byte = data[-back]
            if byte >= 0xC0:
                needs = 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4
                return back if needs > back else 0
            if byte < 0x80:
                return 0
        return 0


class Coder:
    """Pre-tokens to ids for whole texts.  Frequent pre-tokens are remembered as ready decimal ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.fst = Transducer(ranks)
        self.split = regex.compile(pattern)
        self.decimal = {str(rank): token for rank, token in self.fst.token.items()}
        self.words: dict[str, str] = {}

    def ids_of(self, word: str) -> str:
        ids = ",".join(map(str, self.fst.encode(word.encode())))
        if len(word) <= MAX_WORD_CHARS:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            self.words[word] = ids
        return ids

    def chunks(self, text: str) -> Iterator[str]:
        """The ids of a text as decimals joined by commas, some thousand pre-tokens at a time."""
        known, make = self.words.get, self.ids_of
        matches = self.split.finditer(text)
        if len(text) <= CHUNK:
            found = self.split.findall(text)
            if found:
                yield ",".join([known(w) or make(w) for w in found])
            return
        while found := [m.group() for m in islice(matches, CHUNK)]:
            yield ",".join([known(w) or make(w) for w in found])

    def bytes_of(self, decimals: str) -> bytes:
        return b"".join(map(self.decimal.__getitem__, decimals.split(",")))


@lru_cache(maxsize=2)
def coder_for(vocabulary: bytes, pattern: str) -> Coder:
    """One coder per vocabulary and Python process."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, vocabulary.splitlines())}
    return Coder(ranks, pattern)


def coder_source(spark, path: str, pattern: str) -> Callable[[], Coder]:
    """Ship the rank file to the executors; its size is that of a vocabulary, however large the table is."""
    with open(path, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return lambda: coder_for(shared.value, pattern)


def _encode_text(coder: Coder, text: str, want_ids: bool) -> tuple[int, str, str, list[int] | None]:
    ids_hash, text_hash, n, ids = hashlib.sha256(), hashlib.sha256(), 0, [] if want_ids else None
    stream = Utf8Stream()
    for chunk in coder.chunks(text):
        ids_hash.update((chunk if n == 0 else "," + chunk).encode())
        n += chunk.count(",") + 1
        text_hash.update(stream.feed(coder.bytes_of(chunk)).encode())
        if ids is not None:
            ids.extend(map(int, chunk.split(",")))
    text_hash.update(stream.end().encode())
    return n, ids_hash.hexdigest(), text_hash.hexdigest(), ids


def encode_documents(docs: DataFrame, path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, token_ids]), one row per input row.

    Every match of ``pattern`` is encoded by itself, without special tokens; the ids are then decoded again, and the hash of
    the decoded bytes shows the round trip.  Null and empty texts have no tokens and the hash of nothing.  Texts of any length
    are taken piece by piece.  Repeated rows give repeated results; null ids stay null.  Only doc_id and text are read.
    """
    make = coder_source(docs.sparkSession, path, pattern)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    types = [pa.int64(), pa.int64(), pa.string(), pa.string()] + [pa.list_(pa.int32())] * with_ids
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][:len(types)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = make()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                rows = [_encode_text(coder, t.as_py(), with_ids) for t in part.column(1)]
                columns = [part.column(0), *([r[k] for r in rows] for k in range(len(types) - 1))]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids): bytes of the tokens through the incremental decoder.

    A null list gives null.  Ids that are not in the vocabulary raise; bytes that form no code point become U+FFFD.
    """
    make = coder_source(encoded.sparkSession, path, "")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = make().fst.token
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                stream = Utf8Stream("replace")
                texts.append(None if ids is None else "".join([*(stream.feed(token[i]) for i in ids), stream.end()]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")
