"""Spelling variants against all-pairs edit distance."""

import random
import re
import zlib
from collections import Counter

import pytest

from tidewatch.llm import spelling


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    k = 0
    while k < len(a) and a[k] == b[k]:
        k += 1
    return a[k + 1:] == b[k + 1:] if len(a) == len(b) else a[k:] == b[k + 1:]


def brute(rows, min_chars=5, min_count=3, every=97):
    counts = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{word}".encode())
            if h % every == 0:
                k = h % len(word)
                word = word[:k] + word[k + 1:]
            counts[word] += 1
    n = {w: c for w, c in counts.items() if c >= min_count and len(w) >= min_chars}
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        top = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = top if top is not None and n[top] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return sorted(out)


def rows_of(seed, n_words, letters, low=3, high=9):
    rng = random.Random(seed)
    pool = ["".join(rng.choice(letters) for _ in range(rng.randint(low, high))) for _ in range(n_words)]
    for _ in range(n_words):
        w = list(rng.choice(pool))
        k = rng.randrange(len(w) + 1)
        rng.choice([lambda: w.insert(k, rng.choice(letters)), lambda: w.pop(k % len(w)), lambda: w.__setitem__(k % len(w), rng.choice(letters))])()
        pool.append("".join(w))
    text = [w if rng.random() < 0.8 else w.upper() for w in pool for _ in range(rng.choice([0, 1, 2, 3, 4, 8, 9, 20]))]
    rng.shuffle(text)
    return [(i, " 1-".join(text[k:k + 50])) for i, k in enumerate(range(0, len(text), 50))] + [(None, "Straße straße STRAßE strasse"), (3, None), (4, "")]


@pytest.mark.parametrize("seed, letters, q_max, frequent", [(1, "ab", 4, 3), (2, "abcdé", 5, 0), (3, "abcdefgh÷ÿ", 4, 32), (4, "ab", 3, 1), (5, "abc", 8, 5)])
def test_variants_of_random_words(spark, monkeypatch, seed, letters, q_max, frequent):
    monkeypatch.setattr(spelling, "FREQUENT", frequent)
    monkeypatch.setattr(spelling, "HELD_WORDS", 40)
    rows = rows_of(seed, 150, letters)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = spelling.spelling_forms(docs, typo_every=7, q_max=q_max).collect()
    want = brute(rows, every=7)
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert sum(w[4] for w in want) > 100 and any(w[1] and w[2] != w[1] for w in want) or letters != "ab"


def test_long_chains_of_forms(spark):
    """Each word is the form of the one before; the counts double."""
    chain = ["aaaaaaaa"[:8 - k] + "bcdefghi"[:k] for k in range(9)]
    rows = [(k, " ".join([w] * (3 * 2 ** k))) for k, w in enumerate(chain)]
    got = {r.word: r for r in spelling.spelling_forms(spark.createDataFrame(rows, "doc_id long, text string"), typo_every=10**9).collect()}
    want = {r[0]: r for r in brute(rows, every=10**9)}
    assert {w: tuple(r) for w, r in got.items()} == want
    assert len({r.root for r in got.values()}) < len(got)


def test_messy_rows_and_nothing(messy, messy_rows, nothing):
    got = spelling.spelling_forms(messy).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(brute([r[:2] for r in messy_rows]), key=repr)
    assert spelling.spelling_forms(nothing).collect() == []
