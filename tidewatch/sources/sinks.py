"""Writers of the raw, error, anomaly and feature zones, and the retention job."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.schema import ALERT
from tidewatch.session import settle

# Days before raw and processed rows leave their zone.
RAW_DAYS, PROCESSED_DAYS = 90, 365
HOUR_PARTITIONS = ("year", "month", "day", "hour")
# Fixed value: keeps microseconds in JSON files.
JSON_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def with_hour_partitions(df: DataFrame, ts: Column) -> DataFrame:
    parts = {p: F.date_format(ts, f) for p, f in zip(HOUR_PARTITIONS, ("yyyy", "MM", "dd", "HH"))}
    return df.withColumns(parts)


def write_raw(events: DataFrame, path: str, rows_per_file: int = 2_000_000, tasks: int | None = None, mode: str = "append") -> None:
    """Raw zone by source and event hour.

    Rows are gathered by folder first, so a folder gets few files rather than
    one per task.  By default adaptive rebalancing sizes the tasks, splitting a
    busy source-hour and merging quiet ones; ``tasks`` fixes their number.
    """
    out = with_hour_partitions(events.where(F.col("ts").isNotNull()), F.col("ts"))
    folders = ["source", *HOUR_PARTITIONS]
    out = out.hint("rebalance", *folders) if tasks is None else out.repartition(tasks, *folders)
    out.write.mode(mode).option("maxRecordsPerFile", rows_per_file).partitionBy(*folders).parquet(path)


def write_errors(quarantine: DataFrame, path: str, mode: str = "append") -> None:
    """Error zone by reason and day of processing."""
    out = quarantine.withColumn("date", F.current_date())
    out.write.mode(mode).partitionBy("reason", "date").option("timestampFormat", JSON_TIME).json(path)


def write_anomalies(anomalies: DataFrame, path: str, processed_at: Column | None = None, mode: str = "append") -> None:
    """Anomaly zone by hour of processing."""
    now = F.current_timestamp() if processed_at is None else processed_at
    with_hour_partitions(anomalies, now).write.mode(mode).partitionBy(*HOUR_PARTITIONS).option("timestampFormat", JSON_TIME).json(path)


def write_alerts(alerts: DataFrame, path: str, mode: str = "append") -> None:
    alerts.write.mode(mode).option("timestampFormat", JSON_TIME).json(path)


def append_alerts(alerts: DataFrame, path: str) -> int:
    """Append alerts that the table has not got yet, by id; how many were new.

    The table has a folder per date of ``created_at``, and an id depends on the content of its alert, so only the dates that
    the batch touches are looked at.  A batch that is delivered again, or only partly new, adds what is missing and nothing
    else.  One writer at a time.
    """
    spark = alerts.sparkSession
    rows = alerts.select(*ALERT.names, F.to_date("created_at").alias("date")).dropDuplicates(["id"])
    if _exists(spark, path):
        schema = "id string, date date"
        dates = [r.date for r in rows.select("date").distinct().collect()]  # a batch has a few
        known = spark.read.schema(schema).parquet(path).where(F.col("date").isin(dates)).select("id")
        rows = rows.join(known, "id", "left_anti")
    rows = settle(rows.select(*ALERT.names, "date"))
    n = rows.count()
    if n:
        rows.write.mode("append").partitionBy("date").parquet(path)
    return n


def write_features(features: DataFrame, path: str, mode: str = "append") -> None:
    """Offline feature store by date."""
    out = features.withColumn("date", F.to_date("feature_timestamp"))
    out.write.mode(mode).partitionBy("date").parquet(path)


def write_split(train: DataFrame, test: DataFrame, path: str, form: str = "parquet", mode: str = "errorifexists") -> None:
    """Train and test sets; ``csv`` is headerless, ``text`` needs one string column, ``json`` holds sequences."""
    for name, df in (("train", train), ("test", test)):
        writer = df.write.mode(mode).format(form)
        writer.save(f"{path}/{name}")


def _files(spark: SparkSession, path: str):
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def _exists(spark: SparkSession, path: str) -> bool:
    store, place = _files(spark, path)
    return store.exists(place)


def expired_folders(spark: SparkSession, zone: str, before: dt.date) -> Iterator[str]:
    """Partition folders of a zone, relative to it, all of whose days lie before ``before``.

    Only folder names are read: source, then year, month, day (and hour below it), or date.  A year or month that is not over
    before the cutoff is entered, a newer one is passed over; a day goes as a whole with its hours.
    """
    store, root = _files(spark, zone)
    home = root.toUri().getPath()

    def inside(place, known: dict[str, int]) -> Iterator[str]:
        for status in sorted(store.listStatus(place), key=lambda s: s.getPath().getName()):
            name, _, value = status.getPath().getName().partition("=")
            if not status.isDirectory() or not value:
                continue
            below = status.getPath()
            relative = below.toUri().getPath()[len(home):].strip("/") if below.toUri().getPath().startswith(home) else None
            if name == "date":
                if value[:1].isdigit() and dt.date.fromisoformat(value) < before:
                    yield relative
            elif name in ("year", "month", "day") and value.isdigit():
                now = {**known, name: int(value)}
                first = dt.date(now["year"], now.get("month", 1), now.get("day", 1))
                if first >= before:
                    continue
                if name == "day":
                    yield relative
                else:
                    yield from inside(below, now)
            else:
                yield from inside(below, known)

    if store.exists(root):
        yield from inside(root, {})


def _move_files(store, source, target) -> bool:
    """Move what is in one folder into another one, and the emptied folder away; true if everything went."""
    done = True
    for status in store.listStatus(source):
        inside = target.suffix("/" + status.getPath().getName())
        if status.isDirectory() and store.exists(inside):
            done &= _move_files(store, status.getPath(), inside)
            continue
        if store.exists(inside):
            store.delete(inside, False)
        done &= bool(store.rename(status.getPath(), inside))
    return done and bool(store.delete(source, True))


def move_expired(spark: SparkSession, zone: str, archive: str, today: dt.date, days: int = RAW_DAYS) -> DataFrame:
    """Move partitions older than ``days`` from a zone to its archive: (folder, moved).

    No data file is opened; each folder is renamed.  The list of folders is written to ``<archive>/_moves`` first.  A folder that
    is in the archive already, because a run broke off or because late rows came after it, is moved file by file: file names
    are unique, so a file of the same name is the copy a broken move left behind and is replaced, and all others stay.  A
    second run finds nothing to do.
    """
    folders = list(expired_folders(spark, zone, today - dt.timedelta(days=days)))
    plan = spark.createDataFrame([(f,) for f in folders], "folder string").withColumn("planned_at", F.current_timestamp())
    if folders:
        plan.coalesce(1).write.mode("append").json(f"{archive}/_moves")
    store, _ = _files(spark, zone)
    moved = []
    for folder in folders:
        source, target = _files(spark, f"{zone}/{folder}")[1], _files(spark, f"{archive}/{folder}")[1]
        if store.exists(target):
            moved.append((folder, _move_files(store, source, target)))
        else:
            store.mkdirs(target.getParent())
            moved.append((folder, bool(store.rename(source, target))))
    return spark.createDataFrame(moved, "folder string, moved boolean")


def retention(rows: DataFrame, ts: str, now: Column, days: int = RAW_DAYS) -> DataFrame:
    """Mark each row ``keep`` or ``archive``; ``move_expired`` moves the partitions themselves."""
    cutoff = now - F.make_dt_interval(F.lit(days))
    return rows.withColumn("zone", F.when(F.col(ts) < cutoff, "archive").otherwise("keep"))
