"""The five statistical rules, batch form.

A rule states how many earlier samples it needs (``halo``) and how to compute
``(baseline, score)`` of the samples that fire.  All rules of a set run over
one partitioning by (metric_key, block): window frames for the column rules,
one pandas fold per bounded block for rules that are true recurrences.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from typing import ClassVar

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import WindowSpec

from tidewatch.functions.expressions import epoch_seconds, metric_key, metric_sample
from tidewatch.operators.skew import BLOCK_ROWS, row_blocks


def _size(x):
    """Absolute value of a column or a number."""
    return F.abs(x) if isinstance(x, Column) else abs(x)


def _nonzero(x):
    """The value, or nothing where it is zero, so that a quotient by it is nothing too."""
    return F.nullif(x, F.lit(0.0)) if isinstance(x, Column) else x or None


@dataclass(frozen=True)
class Rule:
    """Extension point: subclass and state the decision once, in ``decide``, or as a ``fold`` with an ``update``.

    ``decide`` is written with operators that work on columns and on plain numbers alike: batches feed it the window columns of
    ``frames``, streams feed it numbers that ``update`` keeps in the state of a key (a dict of plain values).  The text of an
    anomaly comes from ``wording`` and ``terms`` in both forms.  ``key_filter`` is a regular expression on metric_key; None
    applies the rule to every key.
    """

    name: str
    key_filter: str | None = None
    # Fold rules see each ordered block as a pandas series instead of columns.
    folds: ClassVar[bool] = False
    wording: ClassVar[str] = "value %.3f, baseline %.3f, score %.2f"

    @property
    def halo(self) -> int:
        return 0

    def frames(self, w: WindowSpec) -> dict[str, Column]:
        """Window columns over rows ordered in ``w``; each is computed once."""
        return {}

    def decide(self, value, frame: dict):
        """(fires, baseline, score) from the value and what ``frames`` names."""
        raise NotImplementedError

    def fold(self, values: pd.Series) -> pd.DataFrame:
        """(baseline, score) per sample of one ordered block; null where the rule is silent."""
        raise NotImplementedError

    def update(self, state: dict, value: float) -> tuple[float, float] | None:
        """(baseline, score) of one sample of a stream, or None; keeps what the next samples need in ``state``."""
        fires, baseline, score = self.decide(value, {})
        return (baseline, score) if fires else None

    def terms(self, value, baseline, score) -> tuple:
        """What ``wording`` shows."""
        return value, baseline, score

    def explain(self, value: Column, baseline: Column, score: Column) -> Column:
        return F.format_string(self.wording_text(), *self.terms(value, baseline, score))

    def say(self, value: float, baseline: float, score: float) -> str:
        return self.wording_text() % self.terms(value, baseline, score)

    def wording_text(self) -> str:
        return self.wording

    def applies(self) -> Column:
        return F.lit(True) if self.key_filter is None else F.col("metric_key").rlike(self.key_filter)


@dataclass(frozen=True)
class ZScore(Rule):
    window: int = 60
    threshold: float = 4.0

    @property
    def halo(self) -> int:
        return self.window - 1

    @property
    def min_samples(self) -> int:
        return max(10, self.window // 6)

    def frames(self, w):
        frame = w.rowsBetween(-(self.window - 1), 0)
        ready = F.count("value").over(frame) >= self.min_samples
        return {"mean": F.avg("value").over(frame), "spread": F.when(ready, F.nullif(F.stddev_samp("value").over(frame), F.lit(0.0)))}

    def decide(self, value, frame):
        z = _size(value - frame["mean"]) / frame["spread"]
        return z >= self.threshold, frame["mean"], z / self.threshold

    def update(self, state, value):
        kept = state["buffer"] = [*state.get("buffer", ()), value][-self.window:]
        if len(kept) < self.min_samples:
            return None
        mean = math.fsum(kept) / len(kept)
        spread = math.sqrt(math.fsum((x - mean) ** 2 for x in kept) / (len(kept) - 1))
        if spread == 0:
            return None
        fires, baseline, score = self.decide(value, {"mean": mean, "spread": spread})
        return (baseline, score) if fires else None

    def wording_text(self):
        return f"|z|=%.2f (mean=%.3f, threshold={self.threshold})"

    def terms(self, value, baseline, score):
        return score * self.threshold, baseline


@dataclass(frozen=True)
class Ewma(Rule):
    """Exponentially weighted mean and variance; scored before the sample is absorbed."""

    folds: ClassVar[bool] = True
    alpha: float = 0.3
    k_sigma: float = 3.0
    warmup: int = 20

    @property
    def halo(self) -> int:
        # After this many steps the weight of any older sample underflows to
        # zero in double precision, so a block needs no state from before.
        return max(self.warmup, math.ceil(800 / -math.log1p(-self.alpha)))

    def update(self, state, value):
        mean, var = state.get("mean", value), state.get("var", 0.0)
        n = state["n"] = state.get("n", 0) + 1
        state["mean"] = self.alpha * value + (1 - self.alpha) * mean
        state["var"] = self.alpha * (value - mean) ** 2 + (1 - self.alpha) * var
        band = self.k_sigma * math.sqrt(var)
        deviation = abs(value - mean)
        if n < self.warmup or band == 0 or deviation <= band:
            return None
        return mean, deviation / band

    def fold(self, values):
        """The recurrence for a whole block: the mean before each sample, then the weighted squares of the deviations from it."""
        mean = values.ewm(alpha=self.alpha, adjust=False).mean().shift(1).fillna(values)
        deviation = (values - mean).abs()
        var = (deviation**2).ewm(alpha=self.alpha, adjust=False).mean().shift(1).fillna(0.0)
        band = self.k_sigma * var**0.5
        ready = pd.Series(range(1, len(values) + 1), index=values.index) >= self.warmup
        fires = ready & (band > 0) & (deviation > band)
        return pd.DataFrame({"baseline": mean.where(fires), "score": (deviation / band.where(band > 0)).where(fires)})

    def wording_text(self):
        return f"deviation %.3f beyond {self.k_sigma} sigma"

    def terms(self, value, baseline, score):
        return (_size(value - baseline),)


@dataclass(frozen=True)
class RateOfChange(Rule):
    threshold_pct: float = 200.0

    @property
    def halo(self) -> int:
        return 1

    def frames(self, w):
        return {"previous": F.lag("value").over(w)}

    def decide(self, value, frame):
        previous = _nonzero(frame["previous"])
        if previous is None:
            return False, None, None
        change = (value - previous) / _size(previous) * 100
        return change >= self.threshold_pct, previous, change / self.threshold_pct

    def update(self, state, value):
        fires, baseline, score = self.decide(value, {"previous": state.get("last")})
        state["last"] = value
        return (baseline, score) if fires else None

    def wording_text(self):
        return "up %.0f%% from %.3f"

    def terms(self, value, baseline, score):
        return score * self.threshold_pct, baseline


@dataclass(frozen=True)
class StaticThreshold(Rule):
    threshold: float = 0.05
    direction: str = ">"

    def decide(self, value, frame):
        limit = float(self.threshold)
        beyond = value > limit if self.direction == ">" else value < limit
        return beyond, limit, _size(value - limit) / max(abs(limit), 1e-9)

    def wording_text(self):
        return f"value %.3f is {'above' if self.direction == '>' else 'below'} the limit of %.3f"

    def terms(self, value, baseline, score):
        return value, baseline


@dataclass(frozen=True)
class DistinctCount(Rule):
    threshold: int = 10_000

    def decide(self, value, frame):
        limit = float(self.threshold)
        return value > limit, limit, value / limit

    def wording_text(self):
        return "%.0f different values, more than %.0f"

    def terms(self, value, baseline, score):
        return value, baseline


def default_rules() -> list[Rule]:
    # Names, order and parameters of the default rule set.
    return [
        ZScore("zscore", window=60, threshold=4.0),
        Ewma("ewma", alpha=0.3, k_sigma=3.0),
        RateOfChange("rate-of-change", threshold_pct=200.0),
        StaticThreshold("error-rate-static", threshold=0.05, direction=">"),
        DistinctCount("ddos-distinct-ips", threshold=10_000),
    ]


def samples_from_events(events: DataFrame) -> DataFrame:
    """(metric_key, value, ts, event_id) of every scorable event."""
    c = F.col
    key = metric_key(c("source"), c("host"), c("metric"), c("metric_value"), c("latency_ms"), c("status"))
    value = metric_sample(c("source"), c("metric_value"), c("latency_ms"), c("status"))
    out = events.select(key.alias("metric_key"), value.cast("double").alias("value"), "ts", "event_id")
    return out.where(F.col("metric_key").isNotNull() & F.col("ts").isNotNull())


def _fold_columns(df: DataFrame, folds: Sequence[tuple[int, Rule]]) -> DataFrame:
    """Add ``_b<i>`` and ``_s<i>`` (baseline and score) by folding each bounded block once."""
    new = [T.StructField(f"_{c}{i}", T.DoubleType()) for i, _ in folds for c in ("b", "s")]
    schema = T.StructType(df.schema.fields + new)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["ts", "event_id"], kind="stable")
        for i, rule in folds:
            try:
                hits = rule.fold(pdf["value"])
                pdf[f"_b{i}"], pdf[f"_s{i}"] = hits["baseline"].astype(float), hits["score"].astype(float)
            except Exception:  # a rule that fails on a block is silent there; the others go on, as on streams
                pdf[f"_b{i}"], pdf[f"_s{i}"] = math.nan, math.nan
        return pdf

    return df.groupBy("metric_key", "_block").applyInPandas(run, schema)


def apply_rules(samples: DataFrame, rules: Sequence[Rule] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """All anomalies of all rules, with ``rule_ord`` keeping the order of the rule set."""
    rules = list(default_rules() if rules is None else rules)
    base = samples.select("metric_key", "value", "ts", "event_id")
    halo = max((r.halo for r in rules), default=0)
    if halo:
        blocks = row_blocks(base, ["metric_key"], "ts", ["ts", "event_id"], halo, max(block_rows, halo + 1))
    else:
        blocks = base.withColumn("_block", F.lit(0).cast("long")).withColumn("_halo", F.lit(False))
    w = Window.partitionBy("metric_key", "_block").orderBy("ts", "event_id")

    # Baseline and score per rule as plain doubles, null where the rule is silent.
    folds = [(i, r) for i, r in enumerate(rules) if r.folds]
    named = {(i, n): c for i, r in enumerate(rules) for n, c in r.frames(w).items()}
    blocks = blocks.select("*", *[c.alias(f"_w{i}_{n}") for (i, n), c in named.items()])
    scored = []
    for i, r in enumerate(rules):
        if r.folds:
            continue
        frame = {n: F.col(f"_w{i}_{n}") for (j, n) in named if j == i}
        fires, baseline, score = r.decide(F.col("value"), frame)
        baseline = baseline if isinstance(baseline, Column) else F.lit(baseline)
        scored.append(F.when(fires, baseline).cast("double").alias(f"_b{i}"))
        scored.append(F.when(fires, score).cast("double").alias(f"_s{i}"))
    blocks = blocks.select(*base.columns, "_block", "_halo", *scored)
    if folds:
        blocks = _fold_columns(blocks, folds)

    found = []
    for i, r in enumerate(rules):
        b, s = (F.nanvl(F.col(f"_{c}{i}"), F.lit(None).cast("double")) if r.folds else F.col(f"_{c}{i}") for c in "bs")
        hit = F.struct(F.lit(i + 1).alias("rule_ord"), F.lit(r.name).alias("detector"), b.alias("baseline"),
                       s.alias("score"), r.explain(F.col("value"), b, s).alias("explanation"))
        found.append(F.when(s.isNotNull() & r.applies(), hit))
    kept = blocks.where(~F.col("_halo")).select(
        "event_id", "metric_key", "ts", "value", F.inline(F.filter(F.array(*found), lambda x: x.isNotNull()))
    )
    return kept.select(
        "event_id", "rule_ord", "detector", "metric_key", "ts", epoch_seconds(F.col("ts")).alias("ts_seen"),
        "value", "baseline", "score", "explanation",
    )


def fuse_scores(samples: DataFrame, anomalies: DataFrame, model_scores: DataFrame) -> DataFrame:
    """One verdict per event from the rules and up to a handful of model scores.

    ``model_scores`` is long: (event_id, model, score, is_anomaly); a model that
    gave no answer simply has no row.  Ties between models go to the name order.
    """
    rules = anomalies.groupBy("event_id").agg(
        F.min_by("detector", "rule_ord").alias("rule"), F.max("score").alias("rule_score"),
        F.min_by("baseline", "rule_ord").alias("rule_baseline"),
    )
    models = model_scores.groupBy("event_id").agg(
        F.min(F.when(F.col("is_anomaly"), F.col("model"))).alias("flagged"), F.max("score").alias("model_score")
    )
    out = samples.join(rules, "event_id", "left").join(models, "event_id", "left")
    zero = F.lit(0.0)
    return out.select(
        "event_id", "metric_key", "value",
        (F.col("rule").isNotNull() | F.col("flagged").isNotNull()).alias("is_anomaly"),
        F.coalesce("rule", "flagged", F.lit("none")).alias("detector"),
        F.greatest(F.coalesce("rule_score", zero), F.coalesce("model_score", zero), zero).alias("score"),
        F.coalesce("rule_baseline", "value").alias("baseline"),
    )
