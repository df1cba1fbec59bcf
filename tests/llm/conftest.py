import random

import pytest
from corpus_texts import changed, prose

SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, size int, grp string, rid int, h string, node int, "
          "slice string, digit string, unit string, keep_id string, _salt int, first string, a int, target string, edits string")


@pytest.fixture(scope="session")
def messy_rows():
    """Nulls, empty and blank texts, a long text, copies, near copies, repeated rows, several rows of one id, a hot source."""
    rng = random.Random(4)
    texts = [None, None, "", "", " \t\n", "one", "one two three", "A b C d E", "a B c D e", "a b c d e f"]
    base = prose(rng, 120)
    texts += [base, base, base.upper(), changed(rng, base, 2), changed(rng, base, 3), changed(rng, base, 12), base + " " + prose(rng, 30)]
    common = prose(rng, 14)
    for _ in range(25):
        texts.append("\n".join([prose(rng, rng.randint(20, 60)), common, prose(rng, 12), "x" * rng.randint(0, 3)]))
    texts += [prose(rng, 20_000), "z" * 50_000, ("la " * 400).strip(), "\n".join([common] * 9), "ü" * 70 + "a", "ü" * 70 + "b"]
    rows = [(i, t, [None, "en", "de"][i % 3], [None, "s0", "s0", "s1", "s2"][i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[11], rows[11], (12, "another text under an id that is taken", "en", "s0", 3), (None, base, "en", "s0", 3), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def messy(spark, messy_rows):
    """The rows with extra columns whose names operators use inside."""
    extra = (1, "g", 2, "h", 3, "s", "d", "u", "k", 4, "f", 5, "t", "e")
    return spark.createDataFrame([r + extra for r in messy_rows], SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(messy):
    return messy.limit(0)
