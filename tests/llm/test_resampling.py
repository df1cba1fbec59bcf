"""Prefix checksums and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpus_texts import prose
from tidewatch.llm import resampling


@pytest.mark.parametrize("size", [1, 7, 255, 5_000, 300_000])
def test_checksums_of_substrings(size):
    rng = np.random.default_rng(size)
    data = rng.integers(0, 256, size).astype(np.uint8)
    sums = resampling.PrefixChecksums(data)
    starts = rng.integers(0, size, 400)
    ends = np.minimum(size, starts + 1 + np.where(rng.random(400) < 0.2, rng.integers(0, size, 400), rng.integers(0, 80, 400)))
    assert sums.of(starts, ends).tolist() == [zlib.crc32(data[a:b].tobytes()) for a, b in zip(starts, ends)]


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def features(text, buckets):
    w = words(text)
    return [zlib.crc32(" ".join(w[i:i + k]).encode()) % buckets for k in (1, 2) for i in range(len(w) - k + 1)]


def brute(rows, target, buckets, percent=25):
    own = [features(t, buckets) for _, t in rows]
    s, t = Counter(b for f in own for b in f), Counter(b for x in target for b in features(x, buckets))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000.0 * math.log(float((t[b] + 1) * (big_s + buckets)) / float((s[b] + 1) * (big_t + buckets))))
            for b in range(buckets)]
    out = []
    for (ident, text), f in zip(rows, own):
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"7:{'' if ident is None else ident}".encode()).hexdigest()[:8], 16)
        out.append([ident, len(f), weight, weight + math.floor(-1000.0 * math.log(-math.log((h + 0.5) / 4294967296.0))), len(words(text)) >= 20])
    able = sorted((r for r in out if r[4]), key=lambda r: (-r[3], r[0] is None, r[0]))
    drawn = {id(r): n + 1 for n, r in enumerate(able[:percent * len(able) // 100])}
    return [(*r[:4], drawn.get(id(r))) for r in out]


@pytest.mark.parametrize("buckets", [50, 10_000, 70_000])
def test_resampling_of_messy_rows(spark, messy, messy_rows, buckets):
    rng = random.Random(3)
    target = [prose(rng, 40) for _ in range(5)] + [None, ""]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    got = resampling.resample(messy, wanted, buckets=buckets).collect()
    want = brute([r[:2] for r in messy_rows], target, buckets)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_ranks_over_many_partitions(spark, monkeypatch):
    monkeypatch.setattr(resampling, "SCAN_BYTES", 2_000)
    rng = random.Random(5)
    rows = [(i, "Ä1-" + prose(rng, rng.choice([0, 5, 19, 20, 60]))) for i in range(400)]
    got = resampling.resample(spark.createDataFrame(rows, "doc_id long, text string").repartition(7),
                              spark.createDataFrame([("the an ing",)], "text string")).collect()
    assert sorted(map(tuple, got)) == sorted(brute(rows, ["the an ing"], 10_000))
    ranks = sorted(r.rank for r in got if r.rank)
    assert ranks == list(range(1, len(ranks) + 1)) and len(ranks) > 30


def test_resampling_of_nothing(nothing, messy):
    assert resampling.resample(nothing, messy.select("text")).collect() == []
    assert len(resampling.resample(messy, nothing).collect()) == messy.count()
