"""State expiry, late rows, topic records, byte admission and compaction on streams."""

import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import rules as R
from tidewatch.sources import readers
from tidewatch.streaming import jobs
from tidewatch.streaming.rules_stream import stream_rules
from tidewatch.streaming.topics import new_records, take_new, topic_events

T0 = datetime(2024, 1, 1)


def stream_of(spark, df, path, parts, files=1):
    for i, part in enumerate(parts):
        df.where(part).coalesce(1).write.mode("append").parquet(f"{path}/p={i}")
        time.sleep(0.05)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(f"{path}/*").drop("p")


def finish(df, path, name):
    q = df.writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/ck-{name}").trigger(availableNow=True).start()
    q.awaitTermination()
    return q


def test_idle_keys_lose_their_state_and_start_anew(spark, tmp_path):
    """Key a falls silent, b goes on: the state of a goes; a comes back and is judged as a new key."""
    rows = [("a", 10.0 + i % 2, T0 + timedelta(seconds=i), i) for i in range(30)]
    rows += [("b", 10.0 + i % 2, T0 + timedelta(seconds=i), 100 + i) for i in range(30)]
    rows += [("b", 10.0 + i % 2, T0 + timedelta(hours=2, seconds=i), 200 + i) for i in range(30)]
    rows += [("b", 11.0, T0 + timedelta(hours=4, seconds=i), 300 + i) for i in range(30)]
    rows += [("a", 99.0, T0 + timedelta(hours=4, seconds=40), 400)]
    df = spark.createDataFrame(rows, "metric_key string, value double, ts timestamp, event_id long")
    parts = ["event_id < 200", "event_id between 200 and 299", "event_id between 300 and 399", "event_id = 400"]
    found = stream_rules(stream_of(spark, df, f"{tmp_path}/in", parts), [R.RateOfChange("rate")], idle=3600)
    q = finish(found, str(tmp_path), "out")
    kept = [p.stateOperators[0].numRowsTotal for p in q.recentProgress if p.stateOperators]
    assert spark.read.parquet(f"{tmp_path}/out").count() == 0  # 99 after 11 would be a jump of 800 %
    assert max(kept) >= 2 and kept[-1] < max(kept) + 2
    # the same without a break: the jump is found
    found = stream_rules(stream_of(spark, df, f"{tmp_path}/in2", ["true"]), [R.RateOfChange("rate")], idle=10**7)
    finish(found, str(tmp_path), "long")
    assert [r.event_id for r in spark.read.parquet(f"{tmp_path}/long").collect()] == [400]


def test_late_rows_are_kept_over_many_batches(spark, tmp_path):
    rng = np.random.default_rng(5)
    n, batches = 520, 104
    lag = np.where(rng.random(n) < 0.2, rng.integers(0, 4000, n), 0)
    rows = [(i, T0 + timedelta(seconds=int(i * 10 - lag[i])) if i % 50 else None, i % batches) for i in range(n)]
    rows.sort(key=lambda r: r[0])
    src = f"{tmp_path}/in"
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "event_id long, ts timestamp")
    local = df.toPandas()
    import os

    os.makedirs(src)
    for b in range(batches):
        local.iloc[b * 5:(b + 1) * 5].to_parquet(f"{src}/{b:04}.parquet", coerce_timestamps="us", allow_truncated_timestamps=True)
        os.utime(f"{src}/{b:04}.parquet", (1_700_000_000 + b, 1_700_000_000 + b))
    stream = spark.readStream.schema("event_id long, ts timestamp_ntz").option("maxFilesPerTrigger", 1).parquet(src).withColumn("ts", F.col("ts").cast("timestamp"))
    jobs.split_late_stream(stream, f"{tmp_path}/on", f"{tmp_path}/late", f"{tmp_path}/ck", None).awaitTermination()
    want, newest = set(), None
    for b in range(batches):
        part = [(i, t) for i, t, _ in rows[b * 5:(b + 1) * 5]]
        want |= {i for i, t in part if newest is not None and t is not None and t < newest - timedelta(seconds=600)}
        newest = max([t for _, t in part if t is not None] + ([newest] if newest else []))
    late = {r.event_id for r in spark.read.parquet(f"{tmp_path}/late").collect()}
    on = {r.event_id for r in spark.read.parquet(f"{tmp_path}/on").collect()}
    assert late == want and 20 < len(late) < 200
    assert not late & on and late | on == set(range(n))


def test_a_replayed_batch_is_split_alike(spark, tmp_path):
    """The commit of the last batch is lost: it runs again and replaces its own rows."""
    import glob
    import os

    df = spark.createDataFrame([(i, T0 + timedelta(seconds=i * 400)) for i in range(12)], "event_id long, ts timestamp")
    parts = ["event_id in (4, 5, 11)", "event_id in (6, 7, 1)", "event_id in (0, 2, 3, 8, 9, 10)"]
    stream = stream_of(spark, df, f"{tmp_path}/in", parts)
    go = lambda: jobs.split_late_stream(stream, f"{tmp_path}/on", f"{tmp_path}/late", f"{tmp_path}/ck", None).awaitTermination()
    go()
    read = lambda z: sorted((r.event_id, r.batch_id) for r in spark.read.parquet(f"{tmp_path}/{z}").collect())
    before = read("on"), read("late")
    assert len(before[0]) + len(before[1]) == 12 and before[1]
    last = max(glob.glob(f"{tmp_path}/ck/commits/[0-9]*"))
    os.remove(last)
    for crc in glob.glob(f"{tmp_path}/ck/commits/.{os.path.basename(last)}*"):
        os.remove(crc)
    go()
    assert (read("on"), read("late")) == before


@pytest.mark.parametrize("seed", [1, 2])
def test_offsets_as_ranges(seed):
    rng = np.random.default_rng(seed)
    starts, ends, seen = [], [], set()
    for _ in range(60):
        offsets = rng.integers(0, 120, 7)
        fresh = take_new(starts, ends, offsets)
        for at, new in zip(offsets[np.argsort(offsets, kind="stable")], fresh[np.argsort(offsets, kind="stable")]):
            assert new == (at not in seen)
            seen.add(at)
    assert {x for a, b in zip(starts, ends) for x in range(a, b)} == seen
    assert all(b < a for b, a in zip(ends, starts[1:]))


def test_a_replayed_offset_range_adds_nothing(spark, tmp_path):
    line = lambda i: f'{{"ts": "2024-01-01T00:00:{i % 60:02}Z", "message": "m{i}", "level": "info"}}'
    rows = [(b"k", line(i).encode() if i % 9 else None, "logs.app", i % 3, i // 3, T0) for i in range(60)]
    again = [r for r in rows if r[4] < 12]
    src = f"{tmp_path}/in"
    for part in (rows[:40], again + rows[40:], rows):
        spark.createDataFrame(part, readers.TOPIC_RECORD).coalesce(1).write.mode("append").parquet(src)
        time.sleep(0.05)
    finish(new_records(readers.stream_topic_files(spark, src, 1)), str(tmp_path), "out")
    got = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.partition, r.offset) for r in got.collect()) == sorted((r[3], r[4]) for r in rows)
    events = topic_events(got).collect()
    assert len(events) == 60 and sum(e.reason is None for e in events) == sum(r[1] is not None for r in rows)


def test_batches_are_admitted_by_bytes_and_files_compacted(spark, tmp_path):
    df = spark.range(4000).select(F.lit("2024-01-01T00:00:00Z").alias("ts"), F.concat(F.lit("m"), "id").alias("message"), (F.col("id") % 2).alias("d"))
    src = f"{tmp_path}/in"
    df.repartition(20).select(F.to_json(F.struct("ts", "message")).alias("value")).write.text(src)
    sizes = []
    q = readers.stream_lines(spark, src, bytes_per_trigger=30_000).writeStream.foreachBatch(lambda b, i: sizes.append(b.count()))
    q.option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
    assert sum(sizes) == 4000 and len(sizes) > 5 and max(sizes) <= 800
    zone = f"{tmp_path}/zone"
    df.repartition(6).write.partitionBy("d").parquet(zone)
    before = sorted(map(tuple, spark.read.parquet(zone).collect()))
    assert jobs.compact(spark, zone, ["d"]) == 2
    files = spark.read.parquet(zone).select("_metadata.file_path").distinct().count()
    assert files == 2 and sorted(map(tuple, spark.read.parquet(zone).collect())) == before
    assert jobs.compact(spark, zone, ["d"]) == 0
