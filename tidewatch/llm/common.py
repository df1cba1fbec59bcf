"""Helpers that several corpus operators share."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.session import scratch_path

#: ASCII blanks split words; everything else belongs to a word.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared scratch folder and read it back.

    It cuts the lineage on storage that outlives every executor, and it is columnar: later passes read only what they use.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(df: DataFrame, name: str) -> DataFrame:
    """As ``stored``, for tables that hold text: half the disk for a little more work."""
    return stored(df, name, "zstd")


def release(table: DataFrame) -> None:
    """Delete the folder of a table that ``stored`` or ``packed`` gave, once all that reads it is stored itself."""
    spark, files = table.sparkSession, table.inputFiles()
    if files:
        folder = spark._jvm.org.apache.hadoop.fs.Path(files[0]).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def words_of(text: Column) -> Column:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a text, in order; an empty array where there is none."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def word_count(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(trimmed, BLANK_RUN))).cast("long")


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)


def join_by_key(rows: DataFrame, keyed: DataFrame, keys: list[str], spread: str, salts: int = 32,
                how: str = "inner") -> DataFrame:
    """Join many rows with a table that has one row per key, although one key may hold a third of the rows.

    Rows of a key are dealt over ``salts`` tasks by a hash of the column ``spread``; the keyed side is repeated for each
    salt.  Null keys match null keys.  The repeats come from a cross join, so that Spark's estimate of the keyed side includes
    them: an exploded array would pass as the size of its file and be broadcast with all repeats.
    """
    left = rows.withColumn("_salt", F.pmod(F.xxhash64(F.col(spread)), F.lit(salts)).cast("int"))
    salt = rows.sparkSession.range(salts).select(F.col("id").cast("int").alias("_salt_k"))
    right = keyed.select(*[F.col(k).alias(f"_k_{k}") for k in keys], *[c for c in keyed.columns if c not in keys]) \
        .crossJoin(F.broadcast(salt))
    on = reduce(lambda a, b: a & b, [same(left[k], right[f"_k_{k}"]) for k in keys], left["_salt"] == right["_salt_k"])
    return left.join(right, on, how).drop("_salt", "_salt_k", *[f"_k_{k}" for k in keys])


#: 64-bit words of the filter below: a table of a fixed size (a few megabytes), however long the list of keys is.
FILTER_WORDS = 1 << 17


def prefiltered(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Most rows whose ``key`` is not among ``wanted`` (one column of that name) leave before any shuffle; a join must follow.

    The wanted keys set bits of a hashed bitmap of fixed size, which is broadcast.  No wanted row is lost; a crowded bitmap only
    lets more of the others through.
    """
    def place(h: str) -> tuple[Column, Column]:
        return F.expr(f"pmod({h}, {FILTER_WORDS}L)").alias("_word"), F.expr(f"shiftleft(1L, cast(pmod(shiftright({h}, 32), 64L) as int))")

    word, bit = place("_h")
    bits = wanted.select(F.xxhash64(key).alias("_h")).select(word, bit.alias("_bit")).groupBy("_word").agg(F.bit_or("_bit").alias("_bits"))
    hashed = rows.withColumn("_h", F.xxhash64(key))
    joined = hashed.withColumn("_at", F.expr(f"pmod(_h, {FILTER_WORDS}L)")).join(F.broadcast(bits), F.col("_at") == F.col("_word"))
    return joined.filter(F.col("_bits").bitwiseAND(bit) != 0).select(*rows.columns)
