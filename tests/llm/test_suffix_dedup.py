"""The suffix merge sort and the removal of repeated passages against brute force."""

import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpus_texts import changed, prose
from tidewatch.llm import suffix_dedup, suffix_sort


def brute(texts, length):
    bodies = [(t or "").encode() for t in texts]
    seen = Counter(b[p:p + length] for b in bodies for p in range(len(b) - length + 1))
    out = []
    for b in bodies:
        gone = bytearray(len(b))
        for p in range(len(b) - length + 1):
            if seen[b[p:p + length]] > 1:
                gone[p:p + length] = b"\1" * length
        spans = sum(gone[i] and not (i and gone[i - 1]) for i in range(len(b)))
        left = bytes(x for x, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), spans, hashlib.sha256(left).hexdigest()))
    return out


def check(spark, texts, length, span):
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in suffix_dedup.without_repeats(docs, length, span, with_bytes=False).collect()}
    want = brute(texts, length)
    assert len(got) == len(texts)
    wrong = [(i, got[i], want[i]) for i in range(len(texts)) if got[i] != want[i]]
    assert not wrong, wrong[:3]
    return want


def random_texts(rng, n, letters):
    """Texts that share passages of all lengths, with copies, periods and single changed letters."""
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(1, 90))) for _ in range(12)]
    out = []
    for _ in range(n):
        parts = [rng.choice(pool) if rng.random() < 0.6 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 40)))
                 for _ in range(rng.randint(0, 6))]
        text = "".join(parts)
        if text and rng.random() < 0.3:
            at = rng.randrange(len(text))
            text = text[:at] + rng.choice(letters) + text[at + 1:]
        out.append(text)
    return out


@pytest.mark.parametrize("seed, length, span, letters", [(1, 20, 8, "ab"), (2, 20, 20, "abcdefgh"), (3, 24, 1, "aé"), (4, 16, 7, "abcd")])
def test_repeats_of_random_texts(spark, monkeypatch, seed, length, span, letters):
    rng = random.Random(seed)
    monkeypatch.setattr(suffix_sort, "RUN_BYTES", 9_000)
    monkeypatch.setattr(suffix_sort, "RANGE_BYTES", 3_000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 64)
    texts = random_texts(rng, 120, letters) + [None, "", "z" * 500, "z" * 19, "ab" * 300, "abc" * 50, "xyz" * 9]
    texts += [texts[3], texts[3], texts[5] + "q"]
    want = check(spark, texts, length, span)
    assert 20 < sum(w[1] > 0 for w in want) < len(texts)


def test_repeats_at_production_length(spark):
    rng = random.Random(8)
    passage, other = prose(rng, 100), prose(rng, 90)
    texts = [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, rng.randint(0, 60)) for _ in range(40)]
    texts += [passage[:399], passage[:400], passage[100:520], prose(rng, 3_000), "z" * 30_000, ("la " * 500) + other, other, None, ""]
    base = prose(rng, 700)
    texts += [base, base, changed(rng, base, 3), changed(rng, base, 40)]
    want = check(spark, texts, 400, 128)
    assert sum(w[1] > 0 for w in want) >= 45


def test_messy_rows_and_nothing(spark, messy, messy_rows, nothing):
    got = suffix_dedup.without_repeats(messy).collect()
    want = [(r[0], *w) for r, w in zip(messy_rows, brute([r[1] for r in messy_rows], 400))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    assert all(hashlib.sha256(r.kept_bytes).hexdigest() == r.kept_sha256 for r in got)
    assert suffix_dedup.without_repeats(nothing).collect() == []


def test_merge_does_not_compare_known_prefixes(monkeypatch):
    """Runs of suffixes of one periodic text: the merge is right, and most contests are settled without a look at the bytes."""
    rng = random.Random(2)
    runs_of = []
    for _ in range(7):
        strings = sorted({("ab" * 200 + "".join(rng.choice("abc") for _ in range(rng.randint(0, 30)))).encode() for _ in range(60)})
        runs_of.append(strings)

    class Run:
        def __init__(self, strings):
            self.strings, self.n, self.text = strings, -1, b""

        def step(self):
            self.n += 1
            last, self.text = self.text, self.strings[self.n] if self.n < len(self.strings) else None
            return None if self.text is None else suffix_sort.common_prefix(last, self.text)  # a run knows it from its coding

    read, real = [], suffix_sort.common_prefix

    def counted(a, b, known=0):
        both = real(a, b, known)
        read.append(both - known)
        return both

    runs = [Run(s) for s in runs_of]
    monkeypatch.setattr(suffix_sort, "common_prefix", counted)
    out = list(suffix_sort.merge_runs(runs))
    steps = sum(real(a, b) for s in runs_of for a, b in zip([b"", *s], s))
    assert sum(read) - steps < 3 * sum(map(len, [s[0] for s in runs_of])) + sum(30 for s in runs_of for _ in s)
    assert [o[3] for o in out] == sorted(x for s in runs_of for x in s)
    assert all(o[2] == real(a[3], o[3]) for a, o in zip(out, out[1:]))


@pytest.mark.parametrize("range_bytes", [300, 10**6])
def test_longest_shared_prefixes(spark, monkeypatch, range_bytes):
    monkeypatch.setattr(suffix_sort, "RANGE_BYTES", range_bytes)
    monkeypatch.setattr(suffix_sort, "RUN_BYTES", 700)
    rng = random.Random(6)
    bodies = [("".join(rng.choice("ab") for _ in range(60)) * rng.choice([1, 2])).encode() for _ in range(12)]
    cuts = [[(p, min(30, len(b) - p), k) for p in range(0, len(b), 3)] for k, b in enumerate(bodies)]
    texts = spark.createDataFrame([(k, b, c) for k, (b, c) in enumerate(zip(bodies, cuts))], f"rid long, body binary, cuts {suffix_dedup.CUTS}").repartition(3)
    got = {(r.rid, r.start): r for r in suffix_sort.longest_shared(texts, "t").collect()}
    all_ = {(k, p): bodies[k][p:p + n] for k, c in enumerate(cuts) for p, n, _ in c}
    for key, text in all_.items():
        want = max(suffix_sort.common_prefix(text, t) for k, t in all_.items() if k != key)
        assert got[key].lcp == want and got[key].tag == key[0]
    assert sum(r.first for r in got.values()) >= len(set(all_.values()))
    assert len(got) == len(all_)
