"""Topic records to events, each record once however often its offsets are delivered."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tidewatch.sources.dialects import normalize
from tidewatch.streaming.rules_stream import ROCKSDB

# The source whose lines a topic carries.
TOPIC_SOURCES = {"logs.app": "app", "logs.nginx": "nginx"}
FRESH = T.StructType([
    T.StructField("topic", T.StringType()), T.StructField("partition", T.IntegerType()), T.StructField("offset", T.LongType()),
    T.StructField("value", T.BinaryType()), T.StructField("timestamp", T.TimestampType())])
_SEEN = T.StructType([T.StructField("starts", T.ArrayType(T.LongType())), T.StructField("ends", T.ArrayType(T.LongType()))])


def take_new(starts: list[int], ends: list[int], offsets: np.ndarray) -> np.ndarray:
    """Marks the offsets seen for the first time, and adds them to the sorted, disjoint ranges [start, end)."""
    fresh = np.zeros(len(offsets), bool)
    for n in np.argsort(offsets, kind="stable"):
        at = int(offsets[n])
        k = bisect_left(ends, at)  # the first range that ends at or behind the offset
        if k < len(starts) and starts[k] <= at < ends[k]:
            continue
        fresh[n] = True
        joins_left = k < len(starts) and ends[k] == at
        right = k + 1 if joins_left else k
        joins_right = right < len(starts) and starts[right] == at + 1
        if joins_left and joins_right:
            ends[k] = ends.pop(right)
            starts.pop(right)
        elif joins_left:
            ends[k] = at + 1
        elif joins_right:
            starts[right] = at
        else:
            starts.insert(k, at)
            ends.insert(k, at + 1)
    return fresh


class OffsetFilter(StatefulProcessor):
    """Lets the first record of each offset of a topic partition pass.

    State per partition: the offsets seen, as ranges.  Offsets grow, so that is one range, or a few where some are still
    missing or were taken out by the broker; records pass chunk by chunk.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.seen = handle.getValueState("seen", _SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        starts, ends = ([], []) if not self.seen.exists() else (list(x) for x in self.seen.get())
        for chunk in rows:
            fresh = take_new(starts, ends, chunk["offset"].to_numpy())
            yield chunk.loc[fresh, FRESH.names]
        self.seen.update((starts, ends))

    def close(self) -> None:
        pass


def new_records(records: DataFrame) -> DataFrame:
    """(topic, partition, offset, value, timestamp): each offset of a stream of topic records once.

    A range of offsets that is delivered again, in the same batch or any later one, adds nothing.
    """
    records.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    return records.select(*FRESH.names).groupBy("topic", "partition").transformWithStateInPandas(
        statefulProcessor=OffsetFilter(), outputStructType=FRESH, outputMode="Append", timeMode="None")


def topic_events(records: DataFrame, sources: dict[str, str] | None = None) -> DataFrame:
    """Records of the known topics as normalised rows (``reason`` is null for an event); other topics are left out.

    The lines of a topic are parsed as those of its source; a record without value is an empty line.
    """
    out = None
    for topic, source in (TOPIC_SOURCES if sources is None else sources).items():
        lines = records.where(F.col("topic") == topic).select(F.coalesce(F.col("value").cast("string"), F.lit("")).alias("value"))
        part = normalize(lines, source)
        out = part if out is None else out.unionByName(part)
    return out
