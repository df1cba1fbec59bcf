"""Operators over the whole corpus against brute force."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from corpus_texts import changed, prose
from tidewatch.llm import exact_dedup, line_dedup, mixing, near_dedup, quality, sharding, url_filter
from tidewatch.llm.components import components


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def key(x):
    return repr(x)


# exact dedup -----------------------------------------------------------------------------------------------------------------

@pytest.mark.parametrize("digit", [1, 3, 64])
def test_exact_groups(messy, messy_rows, digit):
    groups = defaultdict(list)
    for r in messy_rows:
        groups[r[1] or ""].append(r[0])
    want = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i, keep, len(ids), i == keep, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    got = [tuple(r) for r in exact_dedup.exact_groups(messy, first_digit=digit, growth=8 if digit > 1 else 40).collect()]
    assert sorted(got, key=key) == sorted(want, key=key)


def test_exact_groups_of_nothing(nothing):
    assert exact_dedup.exact_groups(nothing).collect() == []


# near dedup ------------------------------------------------------------------------------------------------------------------

def brute_components(rows):
    def shingles(text):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = words(w)
        return frozenset(zip(*(w[k:] for k in range(5)))) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [shingles(r[1]) for r in rows]
    parent = {r[0]: r[0] for r in rows if r[0] is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(rows):
        for j in range(i):
            b = rows[j]
            if a[0] is not None and b[0] is not None and sets[i] and sets[j]:
                both = len(sets[i] & sets[j])
                if 100 * both >= 75 * len(sets[i] | sets[j]):
                    x, y = sorted((find(a[0]), find(b[0])))
                    parent[y] = x
    return [(r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets)]


def test_near_groups_of_messy_rows(messy, messy_rows):
    out = near_dedup.near_groups(messy).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=key) == sorted(brute_components(messy_rows), key=key)
    assert all(r.kept == (r.doc_id is None or r.doc_id == r.component_id) for r in out)


def test_near_groups_of_chains_and_passages(spark):
    """Chains whose ends are not alike, a family around the threshold, and a passage that unrelated texts share."""
    rng = random.Random(9)
    rows, text, passage = [], prose(rng, 100), prose(rng, 40)
    for _ in range(12):
        rows.append(text)
        text = changed(rng, text, 2)
    base = prose(rng, 80)
    rows += [changed(rng, base, rng.randint(0, 4)) for _ in range(60)]
    rows += [passage + " " + prose(rng, rng.randint(10, 60)) for _ in range(40)]
    rows = [(7 * i % 1000, t) for i, t in enumerate(rows)]
    got = near_dedup.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = brute_components(rows)
    assert sorted(tuple(r)[:3] for r in got) == sorted(want)
    assert 20 < len({w[2] for w in want}) < 110


@pytest.mark.parametrize("slice_", [7, 4096])
def test_intersections_of_blocks(slice_, monkeypatch):
    import numpy as np

    monkeypatch.setattr(near_dedup, "SLICE", slice_)
    rng = np.random.default_rng(slice_)
    pool = rng.integers(-2**63, 2**63 - 1, 60)
    sides = [[rng.permutation(pool)[:rng.integers(1, 50)] for _ in range(k)] for k in (9, 6)]
    got = near_dedup._intersections(*sides)
    assert got.tolist() == [[len(set(a) & set(b)) for b in sides[1]] for a in sides[0]]


def test_families_of_many_blocks(spark, monkeypatch):
    """A family of which the first meetings leave many components: all its blocks are compared with each other."""
    rng = random.Random(12)
    base = prose(rng, 90)
    rows = [(i, changed(rng, base, rng.randint(1, 7))) for i in range(90)]
    monkeypatch.setattr(near_dedup, "BLOCK", 8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_dedup.shingle_sets(docs)
    able = sets.select("node", "n")
    meetings = spark.createDataFrame([(0, i) for i in range(1, 90)], "a long, b long")
    none = spark.createDataFrame([], "node long, component long")
    found = components(near_dedup.crossing(able, sets, meetings, none)).collect()
    comp = {r.node: r.component for r in found}
    assert [(i, comp.get(i, i)) for i, _ in rows] == [(i, c) for i, _, c in brute_components(rows)]


def test_prefilter_loses_no_wanted_row(spark, monkeypatch):
    from tidewatch.llm import common

    rows = spark.range(20_000).select("id", F.lit("x").alias("_h2"))
    wanted = spark.range(0, 20_000, 400)
    left = common.prefiltered(rows, "id", wanted)
    assert left.columns == rows.columns
    kept = {r.id for r in left.collect()}
    assert set(range(0, 20_000, 400)) <= kept and len(kept) < 300
    monkeypatch.setattr(common, "FILTER_WORDS", 1)
    assert set(range(0, 20_000, 400)) <= {r.id for r in common.prefiltered(rows, "id", wanted).collect()}
    assert common.prefiltered(rows, "id", wanted.limit(0)).collect() == []


def test_near_groups_of_nothing(nothing):
    assert near_dedup.near_groups(nothing).collect() == []


def test_circulant_signature_estimates_similarity():
    rng = random.Random(1)
    sh = near_dedup.Shingler()
    base = prose(rng, 400)
    other = changed(rng, base, 12)
    a, b = sh.shingles(base), sh.shingles(other)
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    keys = near_dedup.band_keys([a, b], bands=400, rows=1)
    assert abs((keys[0] == keys[1]).mean() - true) < 0.09


def test_one_of_each_keeps_columns(messy, messy_rows):
    out = near_dedup.one_of_each(messy)
    assert out.columns == messy.columns
    kept = {i for i, _, c in brute_components(messy_rows) if i == c}
    assert {r.doc_id for r in out.collect()} - {None} == kept - {None}


def test_components(spark):
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, x) for x in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)]
    parent = {x: x for e in edges for x in e}
    for _ in range(200):
        for a, b in edges:
            parent[a] = parent[b] = min(parent[a], parent[b])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: c for x, c in parent.items() if x in got} and len(got) >= len({x for a, b in edges if a != b for x in (a, b)})


# line dedup ------------------------------------------------------------------------------------------------------------------

def one_edit(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < min(len(a), len(b)) and a[k] == b[k]:
        k += 1
    return a[k + (len(a) >= len(b)):] == b[k + (len(b) >= len(a)):]


def brute_lines(rows):
    seen = {}
    for i, text in rows:
        for p, line in enumerate((text or "").split("\n")):
            if len(line.strip(" ")) >= line_dedup.MIN_CHARS:
                seen.setdefault(line, (i, p))
    near = {x for x in seen for y in seen if x != y and seen[y] < seen[x] and one_edit(x, y)}
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        keep = [x for p, x in enumerate(lines) if x not in seen or (x not in near and seen[x] == (i, p))]
        out.append((i, len(lines), len(lines) - len(keep), "\n".join(keep)))
    return out


@pytest.mark.parametrize("group", [1, 4, 32])
def test_repeated_lines(spark, group, monkeypatch):
    monkeypatch.setattr(line_dedup, "GROUP", group)
    rng = random.Random(group)
    pool = [prose(rng, rng.randint(4, 9)) for _ in range(8)]
    pool.append("y" * 31)

    def variant(line):
        at, how = rng.randrange(len(line)), rng.randrange(5)
        return [line, line[:at] + line[at + 1:], line[:at] + "q" + line[at + 1:], line[:at] + rng.choice("qwx") + line[at:], line[:at] + "zz" + line[at:]][how]

    rows = [(i, "\n".join(variant(rng.choice(pool)) for _ in range(5)) if i % 9 else rng.choice([None, "", "short"])) for i in range(60)]
    got = line_dedup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r) for r in got) == sorted(brute_lines(rows))
    assert sum(r.n_dropped for r in got) > 100


def test_lines_of_messy_rows(messy, messy_rows, nothing):
    out = line_dedup.dedup_lines(messy).collect()
    assert len(out) == len(messy_rows)
    single = [(r[0], r[1]) for r in messy_rows if r[0] is not None and [x[0] for x in messy_rows].count(r[0]) == 1]
    got = {r.doc_id: r for r in out}
    lone = [w for w in brute_lines(sorted(single)) if w[0] > 16]  # ids before these share texts with rows without id
    assert [tuple(got[w[0]]) for w in lone] == lone
    assert line_dedup.dedup_lines(nothing).collect() == []
    kept = line_dedup.documents_without_repeats(messy)
    assert kept.columns == messy.columns
    assert all(r.n_chars is None or r.text is None or r.n_chars == len(r.text) or r.n_chars == 3 for r in kept.collect())


@pytest.mark.parametrize("k", [1, 2, 5])
def test_banded_distance(k):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    rng = random.Random(k)
    left, right = [], []
    for _ in range(300):
        a = [rng.choice("abü") for _ in range(rng.randint(0, 80))]
        b = list(a)
        for _ in range(rng.randint(0, 6)):
            at = rng.randint(0, len(b))
            b[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "c"])
        left.append("".join(a))
        right.append("".join(b))
    assert line_dedup.within(left, right, k).tolist() == [distance(a, b) <= k for a, b in zip(left, right)]


# mixing ----------------------------------------------------------------------------------------------------------------------

def water_fill(sizes, epochs=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, clamped = sum(sizes.values()), set()
    while True:
        rest = total - sum(epochs * sizes[s] for s in clamped)
        share = sum(weight[s] for s in sizes if s not in clamped)
        target = {s: epochs * sizes[s] if s in clamped else weight[s] * rest / share for s in sizes}
        above = {s for s in sizes if s not in clamped and target[s] > epochs * sizes[s]}
        if not above:
            return target
        clamped |= above


def test_mix_of_messy_rows(messy, messy_rows, nothing):
    out = mixing.mix(messy).collect()
    size = Counter()
    for r in messy_rows:
        size[r[3]] += len(words(r[1]))
    target = water_fill(size)
    assert len(out) == len(messy_rows)
    taken = Counter()
    for r in out:
        assert (r.source_size, r.target) == (size[r.source], pytest.approx(target[r.source]))
        assert 0 <= r.repeats <= 3 and r.taken == r.size * r.repeats
        taken[r.source] += r.taken
    largest = {s: max(len(words(r[1])) for r in messy_rows if r[3] == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in size)
    assert sorted(map(repr, out)) == sorted(map(repr, mixing.mix(messy.repartition(5)).collect()))
    assert mixing.mix(nothing).collect() == []
    mixed = mixing.mixed_documents(messy)
    assert mixed.columns == messy.columns
    plan = {r.doc_id: r.repeats for r in out}
    assert Counter(r.doc_id for r in mixed.filter("doc_id between 13 and 40").collect()) == {i: plan[i] for i in range(13, 41) if plan[i]}


def test_mix_of_one_source_and_of_clamped_ones(spark):
    rows = [(i, "w " * (i % 7), f"s{min(i // 10, 3)}") for i in range(400)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len(words(t))
    assert {r.source: r.target for r in out} == {s: pytest.approx(t) for s, t in water_fill(sizes).items()}
    lone = mixing.mix(spark.createDataFrame([(1, "a b", None)], "doc_id long, text string, source string")).collect()
    assert [(r.target, r.taken) for r in lone] == [(2.0, 2)]


# sharding --------------------------------------------------------------------------------------------------------------------

def test_shards_of_messy_rows(messy, messy_rows, nothing):
    out = sharding.balanced_shards(messy).collect()
    assert sorted(((r.doc_id, r.size) for r in out), key=key) == sorted(((r[0], len((r[1] or "").encode()) + 1) for r in messy_rows), key=key)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) <= set(range(8))
    assert sharding.balanced_shards(nothing).collect() == []


def test_shards_are_even_and_groups_stay_together(spark):
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(10, 60)) for _ in range(900)]
    copies = [t for t in texts[:40] for _ in range(rng.randint(1, 5))]
    hot = [prose(rng, 40)] * 450
    rows = list(enumerate(texts + copies + hot))
    out = sharding.balanced_shards(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    size, where = Counter(), defaultdict(Counter)
    text = dict(rows)
    for r in out:
        size[r.shard] += r.size
        where[text[r.doc_id]][r.shard] += 1
    assert max(size.values()) < 1.03 * min(size.values())
    cut = [t for t in texts[:40] if len(where[t]) > 1]
    assert len(cut) <= 2
    # a group of a third of the rows needs three shards or four; it is not strewn over all
    assert sum(n for _, n in where[hot[0]].most_common(4)) > 0.9 * 450


# quality ---------------------------------------------------------------------------------------------------------------------

def brute_base(text):
    w = words(text)
    grams = Counter(zip(w, w[1:], w[2:]))
    covered = {i + k for i, g in enumerate(zip(w, w[1:], w[2:])) if grams[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return (len(w), sum(map(len, w)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed)


def test_base_rules_of_messy_rows(messy, messy_rows, nothing):
    out = quality.judge(messy).collect()
    got = sorted(((r.doc_id, *tuple(r)[1:7]) for r in out), key=key)
    assert got == sorted(((r[0], *brute_base(r[1])) for r in messy_rows), key=key)
    assert all(not r.kept for r in out if r.base_failed)
    assert quality.judge(nothing).collect() == []
    assert quality.kept_documents(messy).columns == messy.columns


def test_outliers_per_group(spark):
    """Junk goes, clean texts stay, in a hot group, in an ordinary one and in a pool of small groups."""
    rng = random.Random(8)
    rows = []
    for i in range(900):
        lang, source = ("en", "hot") if i % 3 else ("de", f"s{i % 40}") if i % 2 else ("fr", "mid")
        w = prose(rng, rng.randint(60, 300)).split()
        if i % 9 == 4:
            w = [x + rng.choice(["***", "###", "$$$"]) for x in w]
        rows.append((i, " ".join(w), lang, source))
    out = quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()
    assert not [r.doc_id for r in out if r.doc_id % 9 == 4 and r.kept]
    assert not [r.doc_id for r in out if r.doc_id % 9 != 4 and not r.kept and not r.base_failed]


def test_labelled_documents(spark):
    """Held-out accuracy: labelled junk goes, labelled clean text stays."""
    sf = "/root/testdata/sf0.01"
    judged = quality.judge(spark.read.parquet(f"{sf}/documents.parquet")).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    rows = judged.filter("not base_failed").collect()
    assert all(r.kept for r in rows if r.quality == 1)
    assert sum(not r.kept for r in rows if r.quality == 0) >= 0.95 * sum(r.quality == 0 for r in rows)


def test_consistency_factor():
    import numpy as np

    x = np.random.default_rng(1).normal(size=(200_000, 4))
    d = (x * x).sum(1)
    core = x[d <= np.quantile(d, 0.75)]
    assert quality.consistency(0.75, 4) == pytest.approx(1 / core.var(axis=0).mean(), rel=0.02)


# urls ------------------------------------------------------------------------------------------------------------------------

def test_url_rules(spark):
    cases = {
        None: ("", "", None, "allow"), "no scheme": ("", "", None, "allow"), "http://": ("", "", None, "allow"),
        "HTTP://WWW.Ä.Example.NET/En/x?q#f": ("www.Ä.example.net".replace("Ä", "Ä"), "/En/x", "net/", "block"),
        "http://a.example.net/en/x": ("a.example.net", "/en/x", "example.net/en/", "allow"),
        "http://example.com/de/": ("example.com", "/de/", "example.com/de/", "block"),
        "http://notexample.com/de/": ("notexample.com", "/de/", None, "allow"),
        "http://b.org/fr/://x": ("b.org", "/fr/://x", "org/fr/", "allow"), "http://net": ("net", "", None, "allow"),
        "http://x.net?a/b": ("x.net", "", None, "allow"), "ftp://h/p#q?r": ("h", "/p", None, "allow"),
    }
    urls = list(cases)
    pages = spark.createDataFrame([(i, u, "h", 1) for i, u in enumerate(urls)], "page_id long, url string, host string, n int")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {urls[r.page_id]: (r.host, r.path, r.rule, r.verdict) for r in url_filter.filter_urls(pages, labels).collect()}
    assert got == cases
    assert url_filter.filter_urls(pages.limit(0), labels).collect() == []


def test_bad_hosts_are_blocked_and_few_outcomes_are_not_enough(spark):
    pages, labels = [], []
    for i in range(2000):
        host = ["good.site.com", "spam.farm.com", "fine.example.org", "b.farm.com"][i % 4]
        pages.append((i, f"http://{host}/{i}"))
        bad = {"spam.farm.com": i % 20 != 1, "b.farm.com": i % 20 != 3}.get(host, i % 40 == 0)
        labels.append((i, 0 if bad else 1, 0))
    pages += [(9000, "http://new.site.com/1"), (9001, "http://unseen.farm.com/1"), (9001, "http://unseen.farm.com/1"), (None, None)]
    labels += [(9000, 0, 0), (None, 0, 1), (5, None, None)]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    verdict = defaultdict(set)
    for r in out.collect():
        verdict[r.host].add(r.verdict)
    assert verdict["spam.farm.com"] == verdict["b.farm.com"] == {"block"}
    assert verdict["good.site.com"] == verdict["fine.example.org"] == verdict["unseen.farm.com"] == verdict["new.site.com"] == {"allow"}
    assert out.count() == len(pages)
