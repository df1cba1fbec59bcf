"""Streaming jobs: ingest, rule scoring and windowed counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidewatch.operators.alerts import notifications
from tidewatch.operators.rules import Rule, samples_from_events
from tidewatch.operators.skew import join_on
from tidewatch.session import settle
from tidewatch.sources.dialects import accepted, normalize, quarantined
from tidewatch.sources.sinks import HOUR_PARTITIONS, JSON_TIME, with_hour_partitions
from tidewatch.streaming.rules_stream import stream_rules

# Delivery interval of the raw zone and allowed lateness of events.
DELIVERY_SECONDS = 300
LATENESS = "10 minutes"
LATE_SECONDS = 600
# Fixed value: what a delivery of the raw zone holds.
FILE_BYTES = 64 << 20
# Longest line the collectors pass on.
MAX_LINE = 32_768


def _start(df: DataFrame, sink, checkpoint: str, seconds: int | None) -> StreamingQuery:
    writer = df.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    # No interval: work off what is there and stop.
    writer = writer.trigger(availableNow=True) if seconds is None else writer.trigger(processingTime=f"{seconds} seconds")
    return writer.start()


def _replace_batch(df: DataFrame, batch_id: int, path: str, form: str, folders: Sequence[str]) -> None:
    """Write the rows of one micro-batch; a replayed batch replaces its own files only."""
    out = df.withColumn("batch_id", F.lit(batch_id)).hint("rebalance", *folders)
    out = out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "batch_id")
    out.format(form).option("timestampFormat", JSON_TIME).save(path) if form == "json" else out.format(form).save(path)


def ingest_stream(lines: DataFrame, source: str, raw_path: str, error_path: str, checkpoint: str,
                  seconds: int | None = DELIVERY_SECONDS, by: Sequence[str] = HOUR_PARTITIONS, max_chars: int = MAX_LINE) -> StreamingQuery:
    """Lines of one source into the raw zone (by event hour, or coarser) and the error zone (by reason).

    Lines of more than ``max_chars`` characters are not parsed: their beginning goes to the error zone as ``too_long``.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        long = F.length("value") > max_chars
        rows = normalize(batch.where(~F.coalesce(long, F.lit(False))), source).persist()
        cut = batch.where(long).select(F.lit(source).alias("source"), F.lit("too_long").alias("reason"),
                                       F.substring("value", 1, max_chars).alias("value"), F.current_timestamp().alias("ingest_ts"))
        try:
            events = with_hour_partitions(accepted(rows), F.col("ts"))
            _replace_batch(events, batch_id, raw_path, "parquet", ["source", *by])
            _replace_batch(quarantined(rows).unionByName(cut), batch_id, error_path, "json", ["reason"])
        finally:
            rows.unpersist()

    return _start(lines, sink, checkpoint, seconds)


def score_stream(events: DataFrame, anomaly_path: str, notify_path: str, checkpoint: str,
                 rules: Sequence[Rule] | None = None, seconds: int | None = 60, watermark: str = LATENESS) -> StreamingQuery:
    """Events to anomalies with state kept between batches; each batch announces its first ten."""

    def sink(batch: DataFrame, batch_id: int) -> None:
        rows = batch.persist()
        try:
            found = with_hour_partitions(rows, F.col("_at")).drop("_at")
            _replace_batch(found, batch_id, anomaly_path, "json", HOUR_PARTITIONS)
            top = notifications(rows.drop("_at")).withColumn("batch_id", F.lit(batch_id))
            writer = top.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch_id")
            writer.option("timestampFormat", JSON_TIME).json(notify_path)
        finally:
            rows.unpersist()

    # The time of a batch is logged with its offsets: a replay finds the same folder again.
    scored = stream_rules(samples_from_events(events), rules, watermark).withColumn("_at", F.current_timestamp())
    return _start(scored, sink, checkpoint, seconds)


def split_late_stream(events: DataFrame, on_time_path: str, late_path: str, checkpoint: str, seconds: int | None = 60,
                      delay_seconds: int = LATE_SECONDS) -> StreamingQuery:
    """Events on time and late ones, each into a zone of its own by batch; none is left out.

    A row is late if it lies more than ``delay_seconds`` behind the newest row of all batches before its own.  Both zones are
    written in the commit of the batch.  The newest time seen so far is kept in the checkpoint folder, for this batch and the one
    before: a replayed batch is judged by the same mark again and replaces its own rows.  Jobs behind it read the zone of
    the rows on time and need no watermark of their own to drop rows.
    """
    spark = events.sparkSession
    marks = f"{checkpoint}/newest"

    def mark_before(batch_id: int):
        if batch_id == 0:
            return None
        found = spark.read.schema("batch_id long, newest_us long").json(f"{marks}/{(batch_id - 1) % 2}").first()
        if found is None or found.batch_id != batch_id - 1:
            raise RuntimeError(f"the mark of batch {batch_id - 1} is missing in {marks}")
        return found.newest_us

    def sink(batch: DataFrame, batch_id: int) -> None:
        before = mark_before(batch_id)
        rows = batch.persist()
        try:
            behind = F.lit(False) if before is None else F.coalesce(F.unix_micros("ts") < before - delay_seconds * 1_000_000, F.lit(False))
            for path, part in ((on_time_path, rows.where(~behind)), (late_path, rows.where(behind))):
                out = part.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                out.partitionBy("batch_id").parquet(path)
            newest = rows.agg(F.unix_micros(F.max("ts"))).first()[0]
            known = [x for x in (before, newest) if x is not None]
            mark = spark.createDataFrame([(batch_id, max(known) if known else None)], "batch_id long, newest_us long")
            mark.coalesce(1).write.mode("overwrite").json(f"{marks}/{batch_id % 2}")
        finally:
            rows.unpersist()

    return _start(events, sink, checkpoint, seconds)


def compact(spark: SparkSession, path: str, folders: Sequence[str], bytes_per_file: int = FILE_BYTES) -> int:
    """Rewrite the folders that hold several files although fewer would do; the number of folders rewritten.

    Streams write small files.  Which folders are crowded is found from names and sizes of files alone.  The rows of these are
    stored beside the zone before they replace their folders.  No stream may write to these folders meanwhile.
    """
    zone = spark.read.parquet(path)
    files = zone.select("_metadata.file_path", "_metadata.file_size", *folders).distinct()
    sizes = files.groupBy(*folders).agg(F.count(F.lit(1)).alias("n"), F.sum("file_size").alias("bytes"))
    crowded = settle(sizes.withColumn("wanted", F.ceil(F.col("bytes") / F.lit(bytes_per_file)).cast("int")).where("n > wanted"))
    n = crowded.count()
    if n == 0:
        return 0
    rows = join_on(zone, crowded.select(*folders, "wanted"), folders)
    # so many tasks a folder as it shall have files; stored before the folders they came from are replaced
    dealt = rows.withColumn("_part", F.floor(F.rand(7) * F.col("wanted")).cast("int")).repartition(*folders, "_part").drop("_part", "wanted")
    settle(dealt).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*folders).parquet(path)
    return n


def windowed_counts(events: DataFrame, window: str = "5 minutes", watermark: str = LATENESS) -> DataFrame:
    """Requests, errors and approximate distinct addresses per closed window and source.

    Counts are additive and the distinct count is a fixed-size sketch, so the
    state per window does not grow with the traffic.
    """
    return events.withWatermark("ts", watermark).groupBy("source", F.window("ts", window)).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("status") >= 500).alias("errors"),
        F.approx_count_distinct("src_ip").alias("about_ips"),
    ).select("source", F.col("window.start").alias("window_start"), "n", "errors", "about_ips")
