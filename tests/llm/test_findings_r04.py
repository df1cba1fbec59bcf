"""Cases of the fourth review: text weights and text forests over large tables."""

import math
import random
import re
from collections import Counter

import pytest
from corpus_texts import prose
from pyspark.sql import functions as F

from tidewatch.operators import forest, textweights, traces
from tidewatch.operators.textweights import GramKeys, _counted, _term_counter
from tidewatch.plans import models

BLANKS = r"[\t-\r \x85\xa0  -     　]+"


def loop_grams(text, lo=2, hi=4):
    out = Counter()
    for word in re.split(BLANKS, text or ""):
        p = f" {word} "
        for n in range(lo, hi + 1) if word else ():
            out.update(p[i:i + n] for i in range(max(len(p) - n + 1, int(n == lo))))
    return out


def odd_texts():
    rng = random.Random(3)
    letters = "abcdé \t\n　\x00\x85​\x1c漢字\U0001f600"
    texts = [None, "", "  ", "a", " a", "a ", "ab", "a  b", "\x00", "q w e r " * 60, "x" * 300]
    return texts + ["".join(rng.choice(letters if rng.random() < 0.5 else "abc ") for _ in range(rng.randint(0, 90))) for _ in range(60)]


@pytest.mark.parametrize("lo,hi", [(2, 4), (3, 3), (2, 2), (1, 2), (4, 5)])
def test_packed_grams_equal_a_loop(lo, hi):
    """Several blanks, no characters, characters of any plane, words and rows longer than a part, more characters than codes."""
    texts = odd_texts()
    want = {(row, g): n for row, t in enumerate(texts) for g, n in loop_grams(t, lo, hi).items()}
    for part, few, many in ((7, 8, 16), (64, 2, 16), (1 << 18, 16, 16), (64, 2, 3)):
        packed = GramKeys(lo, hi, part=part, few=few, many=many) if GramKeys.packs(lo, hi) else None
        got = [((row, grams[n]), c) for rows, number, grams, tf in _counted(texts, lo, hi, packed)
               for row, n, c in zip(rows.tolist(), number.tolist(), tf.tolist())]
        assert len(got) == len(dict(got)) and dict(got) == want
    some = sorted({g for _, g in want})[::2]
    for terms in ({g: i for i, g in enumerate(some)}, {g: 3 * (i * 7919 % len(some)) for i, g in enumerate(some)}, {}):
        found = {}
        for rows, ends, indices, counts in _term_counter(lo, hi, terms)(texts):
            for row, a, b in zip(rows.tolist(), [0, *ends.tolist()], ends.tolist()):
                found[row] = list(zip(indices[a:b].tolist(), counts[a:b].tolist()))
        inside = {}
        for (row, g), n in want.items():
            if g in terms:
                inside.setdefault(row, []).append((terms[g], n))
        assert {row: f for row, f in found.items() if f} == {row: sorted(f) for row, f in inside.items()}


def test_blanks_are_those_of_the_pattern(spark):
    chars = spark.createDataFrame([(i, chr(i)) for i in range(1, 0x3100)], "id int, c string")
    assert {r.id for r in chars.where(F.col("c").rlike(r"(?U)^\s$")).collect()} == set(textweights.UNICODE_BLANKS)


def test_a_task_hands_over_its_grams_once(spark):
    """The vocabulary needs a row for each gram and task, not one for each gram and document."""
    rng = random.Random(8)
    rows = [(i, prose(rng, 50)) for i in range(300)] + [(7, prose(rng, 20)), (None, "two rows"), (None, "two rows more"), (400, None), (401, "É É")]
    docs = spark.createDataFrame(rows, "id long, message string").repartition(3)
    counts = textweights.gram_counts(docs, by_id=False)
    assert counts.columns == ["gram", "tf", "df"]
    texts = {}
    for i, t in rows:
        texts[i] = texts.get(i, "") + " " + (t or "").lower()
    grams = {i: loop_grams(t) for i, t in texts.items()}
    total, df = sum(grams.values(), Counter()), Counter(g for found in grams.values() for g in found)
    shared = sum(len(grams[i]) for i in (7, None))
    assert counts.count() <= 3 * len(total) + shared < sum(map(len, grams.values())) / 5
    n_docs = docs.agg(F.count("*").alias("n_docs"))
    got = {r.gram: (r.total, r.df, r.idf) for r in textweights.vocabulary(counts, n_docs, 10 ** 6).collect()}
    assert got == {g: (n, df[g], pytest.approx(math.log((1 + len(rows)) / (1 + df[g])) + 1)) for g, n in total.items()}
    few = [textweights.vocabulary(c, n_docs, 40).orderBy("gram").collect() for c in (counts, textweights.gram_counts(docs))]
    assert few[0] == few[1]


def test_text_weights_of_a_table(spark, tmp_path):
    """The whole query against loops; ids that come twice or are missing are one document."""
    rng = random.Random(9)
    rows = [(i, prose(rng, rng.randint(1, 60))) for i in range(60)] + [(3, "twice Äß"), (None, "none"), (None, "none at all"), (90, " \n"), (91, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    texts = {}
    for i, t in rows:
        texts[i] = texts.get(i, "") + " " + (t or "").lower()
    grams = {i: loop_grams(t) for i, t in texts.items()}
    df = Counter(g for found in grams.values() for g in found)
    got = {r.id: r for r in models.m07_text_weights(spark, str(tmp_path)).collect()}
    assert got.keys() == {i for i, found in grams.items() if found}
    for i, r in got.items():
        raw = [(1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in grams[i].items()]
        norm = math.sqrt(sum(x * x for x in raw))
        assert (r.terms, r.total, r.largest, r.length) == (len(raw), pytest.approx(sum(raw) / norm, abs=1e-4), pytest.approx(max(raw) / norm, abs=1e-4), pytest.approx(1))


def weighed(spark):
    rng = random.Random(6)
    docs = spark.createDataFrame([(i, prose(rng, 40)) for i in range(400)], "id long, message string").repartition(2)
    counts = textweights.gram_counts(docs, by_id=False)
    vocab = textweights.vocabulary(counts, docs.agg(F.count("*").alias("n_docs")), max_terms=80).cache()
    numbered = traces.dense_ids(vocab, "gram", "idx").cache()
    return textweights.document_terms(docs, numbered), vocab, numbered


def test_lists_of_terms_are_stored_as_bytes(spark):
    terms, vocab, numbered = weighed(spark)
    assert dict(terms.dtypes) == {"id": "bigint", "n": "int", "terms": "binary"}
    rows = textweights.sparse_weights(terms.withColumn("kept", F.col("id") + 1), vocab, numbered)
    assert rows.columns == ["id", "kept", "indices", "values"]
    for r in rows.collect():
        assert r.kept == r.id + 1 and r.indices == sorted(set(r.indices)) and math.hypot(*r["values"]) == pytest.approx(1)


def test_rows_are_drawn_before_they_are_weighed(spark):
    """A text forest weighs the rows of its trees, not the whole table once to count it and once to draw."""
    terms, vocab, numbered = weighed(spark)
    shape = forest.sparse(80)

    def weigh(rows, then=None, schema=""):
        return textweights.sparse_weights(rows, vocab, numbered, then, schema)

    late = forest.fit_isolation_forest(terms, "id", shape, trees=6, samples=16, vectors=weigh)
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" not in plan and plan.index("MapInArrow") < plan.index("Exchange hashpartitioning(tree") < plan.index("Generate explode")
    early = forest.fit_isolation_forest(weigh(terms), "id", shape, trees=6, samples=16)
    nodes = late.orderBy("tree", "node").collect()
    assert nodes == early.orderBy("tree", "node").collect() and {n.tree for n in nodes} == set(range(6))
    assert all(n.mass == 16 for n in nodes if n.node == 0)
    scores = forest.isolation_scores(terms, "id", shape, late, vectors=weigh)
    assert scores._jdf.queryExecution().executedPlan().toString().count("MapIn") == 1
    assert scores.orderBy("id").collect() == forest.isolation_scores(weigh(terms), "id", shape, early).orderBy("id").collect()
