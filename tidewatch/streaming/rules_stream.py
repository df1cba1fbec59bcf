"""Stateful rules on a stream, one small state per metric key."""

from __future__ import annotations

import json
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from tidewatch.operators.rules import Rule, default_rules

OUTPUT = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("rule_ord", T.IntegerType()),
    T.StructField("detector", T.StringType()),
    T.StructField("metric_key", T.StringType()),
    T.StructField("ts", T.TimestampType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("baseline", T.DoubleType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("explanation", T.StringType()),
])
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
# Fixed value: a key without samples for so long (event time) is forgotten.
IDLE_SECONDS = 30 * 86_400
# Anomalies handed on at a time.
_CHUNK = 10_000
_STATE = T.StructType([T.StructField("rules", T.StringType()), T.StructField("last_us", T.LongType())])


class RuleProcessor(StatefulProcessor):
    """Feeds the samples of a key to every rule in (ts, event_id) order of the micro-batch.

    State per key: the bounded fields the rules keep (at most one window of values), stored as one JSON text, and the time of
    the newest sample.  A sample more than ``idle`` seconds behind the newest one before it meets rules that start anew, so a
    state that old is of no use; an event-time timer removes it once the watermark is that far.  Whether the timer has run yet
    makes no difference to the anomalies.

    The samples of a key in one micro-batch are held as three numeric arrays (24 bytes a sample), whatever form they come in;
    how many there can be is set by what a batch admits.  A rule that fails on a sample stays silent for it and does not disturb
    the others.
    """

    def __init__(self, rules: Sequence[Rule], idle: int = IDLE_SECONDS):
        self.rules, self.idle_us = list(rules), idle * 1_000_000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("rules", _STATE)

    def _timer(self, last_us: int) -> int:
        return (last_us + self.idle_us) // 1000 + 1

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [(f["ts"].to_numpy("datetime64[us]").astype(np.int64), f["event_id"].to_numpy(np.int64), f["value"].to_numpy(np.float64)) for f in rows]
        times, ids, values = (np.concatenate(c) for c in zip(*parts))
        order = np.lexsort((ids, times))
        states, last = [{} for _ in self.rules], None
        if self.state.exists():
            text, last = self.state.get()
            states = json.loads(text)
            self.handle.deleteTimer(self._timer(last))
        out: list[tuple] = []
        for n in order:
            ts, value = int(times[n]), float(values[n])
            if last is not None and ts - last > self.idle_us:
                states = [{} for _ in self.rules]
            last = ts if last is None else max(last, ts)
            for i, rule in enumerate(self.rules):
                try:
                    hit = rule.update(states[i], value)
                    text = rule.say(value, *hit) if hit else None
                except Exception:
                    hit = None
                if hit:
                    out.append((int(ids[n]), i + 1, rule.name, key[0], pd.Timestamp(ts, unit="us"), value, *hit, text))
            if len(out) >= _CHUNK:
                yield pd.DataFrame(out, columns=OUTPUT.names)
                out = []
        self.state.update((json.dumps(states), last))
        self.handle.registerTimer(self._timer(last))
        yield pd.DataFrame(out, columns=OUTPUT.names)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.state.exists() and self._timer(self.state.get()[1]) <= expiredTimerInfo.getExpiryTimeInMs():
            self.state.clear()
        return iter([pd.DataFrame([], columns=OUTPUT.names)])

    def close(self) -> None:
        pass


def stream_rules(samples: DataFrame, rules: Sequence[Rule] | None = None, watermark: str = "10 minutes", idle: int = IDLE_SECONDS) -> DataFrame:
    """Anomalies of a stream of (metric_key, value, ts, event_id); rows behind the watermark are left out.

    Keys without a sample for ``idle`` seconds of event time lose their state and start anew.  Late rows that must not get lost
    are set apart before (``jobs.split_late_stream``).
    """
    rules = list(default_rules() if rules is None else rules)
    samples.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    src = samples.select("metric_key", "value", "ts", "event_id").withWatermark("ts", watermark)
    return src.groupBy("metric_key").transformWithStateInPandas(
        statefulProcessor=RuleProcessor(rules, idle), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime",
        eventTimeColumnName="ts",
    )


def rows_behind_watermark(query: StreamingQuery) -> int:
    """How many rows the stateful step has left out as late, over the progress records that the session keeps.

    ``jobs.split_late_stream`` counts and keeps all of them.
    """
    return sum(op["numRowsDroppedByWatermark"] for p in query.recentProgress for op in p["stateOperators"])
