"""Cases of the third round's check: each failed before its finding was settled."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest
from corpus_texts import prose
from tidewatch.llm import bpe, suffix_dedup, token_counts
from tidewatch.llm.vocabulary import production_vocabulary

PATH, PATTERN = production_vocabulary()


def test_short_words_are_counted_without_new_states():
    """Short pre-tokens make no transducer states; counts are those of the transducer, long ones still go through it."""
    rng, coder = random.Random(6), bpe.Coder(bpe.read_ranks(PATH), PATTERN)
    texts = [prose(rng, 60) for _ in range(20)] + ["".join(rng.choice("aéxß日0 \n!'s\U0001f600") for _ in range(300)) for _ in range(20)]
    words = sorted({w for t in texts for w in coder.split.findall(t)}) + ["a", " ", "\U0001f600" * 60, "ab" * 32]
    counter = token_counts.Counter(coder)
    counts = [counter.of(w) for w in words]
    assert len(coder.fst.readings) == 1 and max(map(len, words)) <= bpe.MAX_WORD_CHARS
    assert counts == [len(coder.fst.encode(w.encode())) for w in words]
    made = len(coder.fst.readings)
    long = "xq" * 40_000
    assert counter.of(long) == len(coder.fst.encode(long.encode())) and len(coder.fst.readings) > made and long not in counter.known


@pytest.mark.parametrize("with_bytes", [False, True])
def test_stored_tables_go_when_their_use_ends(spark, with_bytes):
    """Only what the result still reads stays on disk, and the result can be read more than once."""
    rng = random.Random(9)
    passage = prose(rng, 120)
    texts = [prose(rng, 40) + passage + prose(rng, 40) for _ in range(6)] + [passage[:450], prose(rng, 200), None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    before = set(_stored(spark))
    out = suffix_dedup.without_repeats(docs, with_bytes=with_bytes)
    left = {name[:-33] for name in set(_stored(spark)) - before}
    gone = {"anchors", "starts", "runs", "doubtful", "back", "back-runs", "windows", "rest", "rest-runs"} | ({"bodies"} if not with_bytes else set())
    assert not left & {f"suffix-{x}" for x in gone} and "suffix-texts" in left
    first = sorted(map(tuple, out.collect()))
    assert first == sorted(map(tuple, out.collect())) and len(first) == len(texts)
    assert all((r[2] > 0) == (r[0] < 7) for r in first)


def _stored(spark) -> list[str]:
    root = (spark.sparkContext.getCheckpointDir() or "").removeprefix("file:")
    return os.listdir(root) if root else []


def test_windows_of_many_cuts_leave_together():
    """A text with many cuts gives one batch, whose keys do not depend on what is hashed beside them."""
    rng = random.Random(3)
    body = prose(rng, 900).encode()
    names, lo, hi, _ = suffix_dedup.window_starts(np.frombuffer(body, np.uint8), suffix_dedup._Hashes(), 400, 128)
    cuts = [{"start": int(a), "last": int(b), "since": int(a), "until": int(b)} for a, b in zip(lo, hi)]
    kind = pa.list_(pa.struct([(k, pa.int32()) for k in ("start", "last", "since", "until")]))

    def rows(*parts):
        batch = pa.RecordBatch.from_arrays([pa.array([7] * len(parts)), pa.array([body] * len(parts), pa.binary()), pa.array(parts, kind)],
                                           names=["rid", "body", "cuts"])
        batches = list(suffix_dedup._windows(400, 128, 8)([batch]))
        assert len(batches) == 1
        return batches[0].to_pylist()

    assert len(cuts) > 20 and rows(cuts) == rows(*([c] for c in cuts))
    assert sum(r["last"] - r["start"] + 1 for r in rows(cuts)) == len(body) - 399
