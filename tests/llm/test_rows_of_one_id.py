"""Rows that share an id, or have none, in the stages: nothing is lost through the other row, whatever columns are called."""

from corpus_texts import prose

import random

from tidewatch.llm import line_dedup, mixing, near_dedup, quality

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, n_lines int, n_dropped int, _id int, _drop int, _doc_id int, "
          "_kept int, _repeats int, _copy int, mark int, name int, row int, kept int, repeats int")


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", len(t), *range(13)) for i, t in rows], SCHEMA)


def test_lines_of_other_rows_of_an_id_stay(spark):
    common = "a line that stands in several of these texts"
    rows = [(1, common), (5, "first of two under one id, its own line\n" + common), (5, "second of two under one id\nwholly new content lives here"),
            (None, "alpha words that stand nowhere else\n" + common), (None, "gamma\nbeta words that stand nowhere else at all")]
    out = line_dedup.documents_without_repeats(table(spark, rows), short=True)
    assert out.columns == table(spark, rows).columns
    got = out.collect()
    left = [x for r in got for x in r.text.split("\n")]
    assert sorted(left) == sorted({x for _, t in rows for x in t.split("\n")})
    assert all(r.n_lines == 0 and r.n_dropped == 1 and r.row == 10 for r in got)


def test_rows_are_judged_one_by_one(spark):
    rng = random.Random(1)
    good = [(7, prose(rng, 80)), (None, prose(rng, 90)), (7, prose(rng, 85))]
    got = quality.kept_documents(table(spark, [*good, (7, "short"), (None, "short too")])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in got) == sorted((i or 0, t) for i, t in good)
    assert all(r.kept == 11 and r._kept == 5 for r in got)


def test_exact_copies_of_a_row_stay_once(spark):
    rng = random.Random(2)
    a, b = prose(rng, 60), prose(rng, 60)
    got = near_dedup.one_of_each(table(spark, [(3, a), (3, a), (4, a), (9, b)])).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, a), (9, b)] and got[0].repeats == 12


def test_rows_of_an_id_have_counts_of_their_own(spark):
    rng = random.Random(3)
    rows = [(i // 2 if i % 5 else None, prose(rng, rng.choice([5, 200]))) for i in range(40)]
    got = mixing.mixed_documents(table(spark, rows)).collect()
    words = lambda t: len(t.split(" "))
    total = sum(words(t) for _, t in rows)
    assert abs(sum(words(r.text) for r in got) - total) <= 200 and {r.text for r in got} == {t for _, t in rows}
