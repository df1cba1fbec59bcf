"""Cases of the third review: each failed before its finding was settled."""

import random
import re

import pytest
from corpus_texts import prose
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key
from tidewatch.operators import textweights, traces


def test_repeats_of_a_salted_table_are_not_broadcast(spark, tmp_path):
    """A table of under a megabyte is too large for a broadcast once it is there 32 times; one of a few rows is not."""
    keyed = spark.range(20_000).select(F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("k"), F.col("id").alias("v"))
    for name, rows in (("many", keyed), ("few", keyed.limit(9))):
        rows.coalesce(1).write.parquet(str(tmp_path / name))
    rows = spark.range(3_000).select(F.unhex(F.sha2((F.col("id") % 7).cast("string"), 256)).alias("k"), "id")
    rows = rows.unionByName(spark.createDataFrame([(None, -1)], "k binary, id long"))
    for name, kinds in (("many", {"SortMergeJoin"}), ("few", {"BroadcastHashJoin"})):
        out = join_by_key(rows, spark.read.parquet(str(tmp_path / name)), ["k"], "id", how="left")
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert set(re.findall(r"SortMergeJoin|BroadcastHashJoin", plan)) == kinds
        assert {r.id: r.v for r in out.collect()} == {-1: None, **{i: i % 7 for i in range(3_000)}}


def test_grams_are_counted_where_the_texts_are(spark):
    """No (id, gram) row of a document that has its id for itself is shuffled; rows that share an id count together."""
    rng = random.Random(5)
    rows = [(i, prose(rng, 60)) for i in range(80)] + [(7, prose(rng, 30)), (None, "a null id"), (None, "another null"), (90, " \t"), (91, None), (92, "É x")]
    docs = spark.createDataFrame(rows, "id long, message string").repartition(3)
    texts = {}
    for i, t in rows:
        texts[i] = texts.get(i, "") + " " + (t or "")
    want = {}
    for i, t in texts.items():
        for w in t.lower().split():
            p = f" {w} "
            for g in (p[k:k + n] for n in (2, 3, 4) for k in range(len(p) - n + 1)):
                want[i, g] = want.get((i, g), 0) + 1
    counts = textweights.gram_counts(docs)
    assert {(r.id, r.gram): r.tf for r in counts.collect()} == want and counts.count() == len(want)
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert re.findall(r"hashpartitioning\(id#\d+L?, (\w+)#", plan).count("w") == 0 and "LeftSemi" in plan and "LeftAnti" in plan

    vocab = textweights.vocabulary(counts, docs.agg(F.count("*").alias("n_docs")), max_terms=60).cache()
    numbered = traces.dense_ids(vocab, "gram", "idx").cache()
    terms = textweights.document_terms(docs, numbered)
    flat = textweights.sparse_rows(textweights.tfidf(counts, vocab), numbered)
    got = {r.id: r for r in textweights.sparse_weights(terms, vocab, numbered).collect()}
    expected = {r.id: r for r in flat.collect()}
    assert got.keys() == expected.keys() and len(got) == terms.count()
    for i, r in expected.items():
        assert got[i].indices == r.indices and got[i]["values"] == pytest.approx(r["values"])
