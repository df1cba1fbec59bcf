"""Readers of event files, feature files, alert history and live streams."""

from __future__ import annotations

from collections.abc import Sequence
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamReader

from tidewatch.schema import ALERT, EVENT

# Topics the collectors publish to.
TOPICS = ("logs.app", "logs.nginx")
MYSQL_SEPARATOR = "# Time: "
# Columns of a topic record that the jobs use.
TOPIC_RECORD = "key binary, value binary, topic string, partition int, offset bigint, timestamp timestamp"


def read_events_json(spark: SparkSession, path: str, schema: T.StructType = EVENT) -> DataFrame:
    """JSON-lines events in a folder tree."""
    return spark.read.schema(schema).option("recursiveFileLookup", True).json(path)


def read_events_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_raw_zone(spark: SparkSession, path: str, merge_schema: bool = False) -> DataFrame:
    """Raw zone with its source and hour folders as partition columns.

    ``merge_schema`` reads every footer; use it only after a source gained columns.
    """
    return spark.read.option("mergeSchema", merge_schema).parquet(path)


def read_errors(spark: SparkSession, path: str) -> DataFrame:
    """Error zone with its reason and date folders as partition columns."""
    return spark.read.schema("source string, value string, ingest_ts timestamp").json(path)


def read_records(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The records of ``record_lines`` that could be read."""
    return record_lines(spark, path, schema).where(F.col("reason").isNull()).select("record.*")


def record_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """(record, text, reason) of JSON files that hold either one array or one object per line.

    The first character of a file that is no blank tells which, found in the block at its start.  Object files are read line by
    line and split like any text; a line that is no object keeps its text in ``text`` and gets a ``reason``.  A record is a
    struct of the ``schema``, so its fields may have any name.  Array files go through the streaming parser, one file per task, because
    an array may be laid out in any way; only their names visit the driver, which lists all files anyway.
    """
    lines = spark.read.option("recursiveFileLookup", True).text(path).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("at"))
    lines = lines.where(F.trim("value") != "")
    heads = lines.where("start = 0").groupBy("file").agg(F.min_by("value", "at").alias("head"))
    names = [r.file for r in heads.where(F.ltrim("head").startswith("[")).select("file").collect()]
    spare = "_corrupt"
    while spare in schema.names:
        spare += "_"
    raw = T.StructType([*schema.fields, T.StructField(spare, T.StringType())])
    options = {"columnNameOfCorruptRecord": spare}
    record = F.struct(*[F.col("r")[n].alias(n) for n in schema.names]).alias("record")
    parsed = lines.where(~F.col("file").isin(names)) if names else lines
    parsed = parsed.select("value", F.from_json("value", raw, options).alias("r"))
    broken = F.col("r").isNull() | F.col("r")[spare].isNotNull() | ~F.ltrim("value").startswith("{")
    out = parsed.select(record, F.col("value").alias("text"), F.when(broken, "bad_json").alias("reason"))
    if names:
        whole = spark.read.schema(raw).options(multiLine=True, **options).json([unquote(n) for n in names]).select(F.struct("*").alias("r"))
        out = out.unionByName(whole.select(record, F.col("r")[spare].alias("text"), F.when(F.col("r")[spare].isNotNull(), "bad_json").alias("reason")))
    return out


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Non-blank, trimmed ``message`` of JSON-lines logs; broken lines are skipped."""
    rows = spark.read.schema("message string").option("recursiveFileLookup", True).json(path)
    return log_lines(rows)


def log_lines(rows: DataFrame, column: str = "message") -> DataFrame:
    text = F.regexp_replace(column, r"^\s+|\s+$", "")
    return rows.withColumn(column, text).where(F.col(column) != "")


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("recursiveFileLookup", True).text(path)


def read_mysql_blocks(spark: SparkSession, path: str) -> DataFrame:
    """Slow-query log cut into one ``value`` per entry."""
    blocks = spark.read.option("lineSep", MYSQL_SEPARATOR).option("recursiveFileLookup", True).text(path)
    blocks = blocks.where(F.trim("value") != "")
    return blocks.select(F.concat(F.lit(MYSQL_SEPARATOR), "value").alias("value"))


def read_feature_csv(spark: SparkSession, path: str, names: Sequence[str]) -> DataFrame:
    schema = T.StructType([T.StructField(n, T.DoubleType()) for n in names])
    return spark.read.schema(schema).option("header", False).csv(path)


def read_alerts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ALERT).json(path)


def read_baseline_json(spark: SparkSession, path: str) -> DataFrame:
    """Import a ``statistics.json`` document: one row per feature with edges and counts."""
    stat = ("struct<count: bigint, missing: bigint, mean: double, std: double, min: double, max: double, p01: double, "
            "p25: double, p50: double, p75: double, p99: double, histogram: struct<edges: array<double>, counts: array<bigint>>>")
    doc = spark.read.option("wholetext", True).text(path)  # a document has one entry per feature column
    rows = doc.select(F.explode(F.from_json("value", f"map<string, {stat}>")).alias("feature", "s"))
    return rows.select("feature", "s.*").select("*", "histogram.edges", "histogram.counts").drop("histogram")


def decode_batch(records: DataFrame, data: Column, schema: T.StructType | str) -> DataFrame:
    """Base64 JSON records of a delivery batch: parsed ``event`` or a ``reason``."""
    text = F.try_to_binary(data, F.lit("base64")).cast("string")
    out = records.withColumn("_text", text)
    event = F.from_json("_text", schema)
    valid = F.try_parse_json("_text").isNotNull() & F.ltrim("_text").startswith("{")
    reason = (F.when(data.isNull() | (data == ""), "no_data").when(F.col("_text").isNull(), "bad_base64")
              .when(~F.coalesce(valid, F.lit(False)), "bad_json"))
    return out.select("*", reason.alias("reason"), F.when(reason.isNull(), event).alias("event")).drop("_text")


def _admitted(reader: DataStreamReader, files: int, bytes_: int | None) -> DataStreamReader:
    """What one micro-batch may take: so many files, or so many bytes (at least one file)."""
    return reader.option("maxFilesPerTrigger", files) if bytes_ is None else reader.option("maxBytesPerTrigger", str(bytes_))


def stream_events(spark: SparkSession, path: str, schema: T.StructType = EVENT, files_per_trigger: int = 100,
                  bytes_per_trigger: int | None = None) -> DataFrame:
    return _admitted(spark.readStream.schema(schema), files_per_trigger, bytes_per_trigger).json(path)


def stream_lines(spark: SparkSession, path: str, files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """Log files as a stream of lines; the ingest job sends over-long ones to the error zone."""
    return _admitted(spark.readStream, files_per_trigger, bytes_per_trigger).text(path)


def stream_topic_files(spark: SparkSession, path: str, files_per_trigger: int = 100, bytes_per_trigger: int | None = None) -> DataFrame:
    """Topic records from files, in the shape the connector gives them."""
    return _admitted(spark.readStream.schema(TOPIC_RECORD), files_per_trigger, bytes_per_trigger).parquet(path)


def stream_kafka(spark: SparkSession, servers: str, topics: Sequence[str] = TOPICS, records_per_trigger: int | None = None) -> DataFrame:
    """Topic records; needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", ",".join(topics))
    if records_per_trigger is not None:
        reader = reader.option("maxOffsetsPerTrigger", records_per_trigger)
    return reader.load().select(*(c.split()[0] for c in TOPIC_RECORD.split(", ")))
