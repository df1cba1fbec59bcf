"""Quality rules: fixed base rules and robust multivariate outliers by minimum covariance determinant."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key, stored, text_or_empty, words_of

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"

#: The statistic vector and the least spread of each coordinate, which holds where the estimate is smaller.  Most clean texts have
#: no symbol and no repetition at all, so the estimated spread of those coordinates is often zero; the floors state what is still
#: ordinary, and leave each coordinate room to reject by itself what the base rules let pass.
FLOORS = {"z_length": 0.06, "z_symbols": 0.4, "z_repeats": 0.13, "z_lines": 0.16}
#: Share of rows that the covariance determinant is minimised over, concentration steps, and the share of normal vectors
#: that lie beyond the squared distance at which a text is an outlier.
CORE_SHARE = 0.75
STEPS = 3
TAIL = 1e-6
#: Groups of fewer rows are estimated together: first per language, then all of them; fewer rows than LEAST give no verdict.
MIN_GROUP = 50
LEAST = 20


def text_statistics(docs: DataFrame, keep: list[Column] | None = None) -> DataFrame:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and n_lines (lines with a word).

    A window of three words is repeated if it occurs twice or more in the text; ``n_repeat_words`` counts the words that lie
    in some repeated window.  Windows are compared by a 64-bit hash of their words within one text; sorting (hash, position)
    brings equal ones together, so the cost is n log n in the words of the text and nothing leaves its row.
    """
    text = text_or_empty()
    rows = docs.select(*(keep or []), text.alias("_text"), words_of(text).alias("_words"))
    n = F.size("_words")
    w = F.col("_words")
    triples = F.when(n < 3, F.array().cast("array<struct<h:bigint,p:int>>")).otherwise(F.transform(
        F.arrays_zip(F.slice(w, F.lit(1), n - 2).alias("a"), F.slice(w, F.lit(2), n - 2).alias("b"),
                     F.slice(w, F.lit(3), n - 2).alias("c")),
        lambda x, i: F.struct(F.xxhash64(x["a"], x["b"], x["c"]).alias("h"), i.alias("p"))))
    with_word = F.filter(F.split("_text", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select("*", F.sort_array(triples).alias("_sorted"), with_word.alias("_lines"))
    m = F.size("_sorted")
    s = F.col("_sorted")
    neighbours = F.when(m < 2, F.array().cast("array<struct<a:struct<h:bigint,p:int>,b:struct<h:bigint,p:int>>>")).otherwise(
        F.arrays_zip(F.slice(s, F.lit(1), m - 1).alias("a"), F.slice(s, F.lit(2), m - 1).alias("b")))
    twice = F.filter(neighbours, lambda x: x["a"]["h"] == x["b"]["h"])
    starts = F.sort_array(F.array_distinct(F.flatten(F.transform(twice, lambda x: F.array(x["a"]["p"], x["b"]["p"])))))
    covered = F.aggregate(
        starts, F.struct(F.lit(0).alias("sum"), F.lit(0).alias("end")),
        lambda acc, p: F.struct((acc["sum"] + p + 3 - F.greatest(p, acc["end"])).alias("sum"), (p + 3).alias("end")),
        lambda acc: acc["sum"])
    return rows.select(
        *[c for c in rows.columns if c not in ("_text", "_words", "_sorted", "_lines")],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_words", "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_text", f"[^{SYMBOLS}]+", "")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.size("_lines").cast("long").alias("n_lines"))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _share(part: str, whole: str) -> Column:
    return F.asin(F.sqrt(F.col(part) / F.greatest(F.col(whole), F.lit(1))))


def vectors() -> dict[str, Column]:
    """Transformations that bring the statistics near to normal: logarithms for ratios, arc sines for shares."""
    words = F.greatest(F.col("n_words"), F.lit(1))
    return {
        "z_length": F.log(F.greatest(F.col("word_chars"), F.lit(1)) / words),
        "z_symbols": F.log1p(100 * F.col("n_symbols") / words),
        "z_repeats": _share("n_repeat_words", "n_words"),
        "z_lines": _share("n_dup_lines", "n_lines"),
    }


def judge(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, distance, kept), a row per row.

    A row is kept unless it fails a base rule or its statistic vector lies further from the centre of its (language, source)
    group than all but a share of TAIL of normal vectors do (chi-square quantile of the squared robust distance).  Centre and covariance come from the minimum-covariance-determinant method:
    start at median and median deviation, then repeat concentration steps, each of which re-estimates from the three quarters
    of the group that lie nearest.  Rows that fail a base rule do not take part in the estimates.

    Null language or source is a group value of its own.  Null text is empty, has no words and fails.  Small groups are
    pooled (see MIN_GROUP); with fewer than LEAST rows in the last pool the base rules alone decide, and ``distance`` is null.
    Repeated rows are judged each for itself.  Only doc_id, text, lang and source are read.  An empty table gives no rows.
    """
    keep = [F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
            F.col("source").cast("string").alias("source")]
    stats = text_statistics(docs, keep).withColumn("base_failed", base_failed())
    rows = stored(stats.select("*", *[c.alias(k) for k, c in vectors().items()]), "quality")
    pooled = stored(with_units(rows).drop("lang", "source"), "quality-pooled")
    estimate = fit(pooled.filter("not base_failed and sized"))
    return with_distance(pooled, estimate, "left").select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        F.col("d2").alias("distance"), (~F.col("base_failed") & ~F.coalesce(F.col("d2") > _chi2_quantile(1 - TAIL, len(FLOORS)), F.lit(False))).alias("kept"))


def with_units(rows: DataFrame) -> DataFrame:
    """Add the unit of estimation: the row's own group, or the pool that takes in small groups."""
    n = F.count(F.when(~F.col("base_failed"), 1))
    groups = rows.groupBy("lang", "source").agg(n.alias("n"))
    small = F.col("n") < MIN_GROUP
    by_lang = groups.filter(small).groupBy(F.col("lang").alias("_lang")).agg(F.sum("n").alias("n_lang"))
    groups = groups.join(by_lang, F.col("lang").eqNullSafe(F.col("_lang")), "left").drop("_lang")
    lone = small & (F.col("n_lang") < MIN_GROUP)
    rest = groups.filter(lone).agg(F.sum("n").alias("n_rest"))
    groups = groups.crossJoin(F.broadcast(rest))  # one row
    unit = F.when(lone, F.lit("all")).when(small, F.concat(F.lit("lang:"), F.coalesce("lang", F.lit("")))).otherwise(
        F.to_json(F.struct("lang", "source")))
    sized = F.when(lone, F.col("n_rest")).when(small, F.col("n_lang")).otherwise(F.col("n")) >= LEAST
    units = stored(groups.select("lang", "source", unit.alias("unit"), sized.alias("sized")), "quality-units")
    return join_by_key(rows, units, ["lang", "source"], "doc_id")


def fit(rows: DataFrame) -> DataFrame:
    """(unit, centre c_i, lower Cholesky factor l_i_j of the covariance) by concentration steps."""
    names = list(FLOORS)
    medians = rows.groupBy("unit").agg(*[F.percentile_approx(z, 0.5, 1000).alias(f"c_{i}") for i, z in enumerate(names)])
    centred = join_by_key(rows, medians, ["unit"], "doc_id")
    spreads = centred.groupBy("unit").agg(
        *[F.first(f"c_{i}").alias(f"c_{i}") for i in range(len(names))],
        *[F.percentile_approx(F.abs(F.col(z) - F.col(f"c_{i}")), 0.5, 1000).alias(f"m_{i}") for i, z in enumerate(names)])
    start = {f"s_{i}_{i}": F.greatest((1.4826 * F.col(f"m_{i}")) ** 2, F.lit(floor**2)) for i, floor in enumerate(FLOORS.values())}
    start |= {f"s_{i}_{j}": F.lit(0.0) for i in range(len(names)) for j in range(i)}
    estimate = stored(_factor(spreads.select("*", *[c.alias(k) for k, c in start.items()])), "mcd")
    for _ in range(STEPS):
        near = with_distance(rows, estimate).groupBy("unit").agg(F.percentile_approx("d2", CORE_SHARE, 1000).alias("core"))
        bounded = stored(estimate.join(near, "unit"), "mcd")
        core = with_distance(rows, bounded).filter("d2 <= core")
        estimate = stored(_factor(_moments(core)), "mcd")
    return estimate


def _moments(core: DataFrame) -> DataFrame:
    """Mean and covariance per unit in one aggregation, widened for having left out the outer quarter."""
    names = list(FLOORS)
    # deviations from the last centre keep the sums of squares small
    dev = core.select("unit", *[f"c_{i}" for i in range(len(names))],
                      *[(F.col(z) - F.col(f"c_{i}")).alias(f"x_{i}") for i, z in enumerate(names)])
    sums = dev.groupBy("unit").agg(
        *[F.first(f"c_{i}").alias(f"o_{i}") for i in range(len(names))],
        *[F.avg(f"x_{i}").alias(f"a_{i}") for i in range(len(names))],
        *[F.avg(F.col(f"x_{i}") * F.col(f"x_{j}")).alias(f"p_{i}_{j}") for i in range(len(names)) for j in range(i + 1)])
    widen = consistency(CORE_SHARE, len(names))
    floors = list(FLOORS.values())

    def spread(i: int, j: int) -> Column:
        return widen * (F.col(f"p_{i}_{j}") - F.col(f"a_{i}") * F.col(f"a_{j}"))

    return sums.select(
        "unit", *[(F.col(f"o_{i}") + F.col(f"a_{i}")).alias(f"c_{i}") for i in range(len(names))],
        *[(F.greatest(spread(i, j), F.lit(floors[i] ** 2)) if i == j else spread(i, j)).alias(f"s_{i}_{j}")
          for i in range(len(names)) for j in range(i + 1)])


def _factor(estimates: DataFrame) -> DataFrame:
    """Cholesky factor of each unit's covariance, column by column."""
    p = len(FLOORS)
    for j in range(p):
        for i in range(j, p):
            left = F.col(f"s_{i}_{j}") - reduce(lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
                                                                      for k in range(j)], F.lit(0.0))
            value = F.sqrt(F.greatest(left, F.lit(1e-12))) if i == j else left / F.col(f"l_{j}_{j}")
            estimates = estimates.withColumn(f"l_{i}_{j}", value)
    return estimates.select("unit", *[f"c_{i}" for i in range(p)], *[f"l_{i}_{j}" for i in range(p) for j in range(i + 1)])


def with_distance(rows: DataFrame, estimate: DataFrame, how: str = "inner") -> DataFrame:
    """Add the squared Mahalanobis distance ``d2`` by forward substitution through the factor."""
    joined = join_by_key(rows, estimate, ["unit"], "doc_id", how=how)
    solved: list[Column] = []
    for i, z in enumerate(FLOORS):
        joined = joined.withColumn(f"y_{i}", (F.col(z) - F.col(f"c_{i}") - reduce(
            lambda a, b: a + b, [F.col(f"l_{i}_{k}") * F.col(f"y_{k}") for k in range(i)], F.lit(0.0))) / F.col(f"l_{i}_{i}"))
        solved.append(F.col(f"y_{i}") * F.col(f"y_{i}"))
    return joined.withColumn("d2", reduce(lambda a, b: a + b, solved))


def consistency(share: float, p: int) -> float:
    """Factor that makes the covariance of the nearest ``share`` of normal vectors estimate that of all of them."""
    return share / _chi2_below(_chi2_quantile(share, p), p + 2)


def _chi2_quantile(share: float, p: int) -> float:
    low, high = 0.0, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_below(mid, p) < share else (low, mid)
    return low


def _chi2_below(x: float, p: int) -> float:
    """P(chi-square with p degrees of freedom < x), by the series of the incomplete gamma function."""
    a, half = p / 2, x / 2
    term = total = 1 / a
    for k in range(1, 1000):
        term *= half / (a + k)
        total += term
    return total * math.exp(-half + a * math.log(half) - math.lgamma(a)) if half > 0 else 0.0


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with their own columns only.

    Each row is judged for itself: rows are named by a hash of all that ``judge`` reads, so rows that share an id, or have none,
    do not answer for each other, and rows alike in everything share one verdict.
    """
    name = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", "lang", "source")
    rows = docs.select(F.struct("*").alias("row"), name.alias("name"))
    verdicts = judge(docs.select(name.alias("doc_id"), "text", "lang", "source")).groupBy(F.col("doc_id").alias("judged")).agg(F.min("kept").alias("kept"))
    return rows.join(verdicts, F.col("name") == F.col("judged")).filter("kept").select(*[F.col("row")[c].alias(c) for c in docs.columns])
