"""Exact duplicates by distributed most-significant-digit radix partitioning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import stored, text_or_empty

#: Bytes of the first digit, and how much wider each following digit is.
FIRST_DIGIT = 64
GROWTH = 8
SALTS = 64


def exact_groups(docs: DataFrame, first_digit: int = FIRST_DIGIT, growth: int = GROWTH) -> DataFrame:
    """Groups of equal texts: (doc_id, keep_id, group_size, kept, text_sha256), one row per input row.

    Each pass splits the open groups by the next bytes of their texts (the digit).  A group that has become a single row, or
    whose texts end inside the digit, is settled; only the others carry their text into the next pass, so a text takes part
    as long as somebody shares all its bytes so far.  Digits grow geometrically: the number of passes is logarithmic in the
    longest shared prefix.  Equality is decided by the bytes alone; ``text_sha256`` is output only.

    Counts are combined per (group, digit, salt) before they meet per group, and rows join the salted counts, so a group of
    copies that holds a third of the table is spread over ``SALTS`` tasks.

    Null text counts as empty; empty texts form one group.  Of equal texts the largest ``doc_id`` stays.  Rows that repeat
    this ``doc_id`` and text are the same document and all marked as kept; null ids sort below all others, and are kept only
    where no equal text has an id.  Only ``doc_id`` and ``text`` are read, so further columns cannot clash.  An empty table
    gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("body"),
                       F.sha2(text_or_empty(), 256).alias("text_sha256"), F.lit(None).cast("binary").alias("grp"))
    settled, offset, width = [], 0, first_digit
    while True:
        split = _split(rows, offset, width, first=offset == 0)
        out = stored(split, "radix")
        settled.append(out.filter("settled").select("doc_id", "keep_id", "group_size", "text_sha256"))
        rows = out.filter("not settled").select("doc_id", "body", "text_sha256", "grp", "rid")
        if rows.select("rid").isEmpty():
            break
        offset, width = offset + width, width * growth
    return reduce(DataFrame.unionByName, settled).select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def _split(rows: DataFrame, offset: int, width: int, first: bool) -> DataFrame:
    """One pass: the group of each row under the next digit, and whether the row is settled."""
    key = ["digit", "ended"] if first else ["grp", "digit", "ended"]
    keyed = rows.withColumns({
        "digit": F.substring("body", offset + 1, width),
        "ended": F.length("body") <= offset + width,
        "salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"),
    })
    # the first pass names a group by its digit, later ones by a row id that was stored with the pass before
    label = F.lit(None).cast("long") if first else F.max("rid")
    parts = keyed.groupBy(*key, "salt").agg(F.count(F.lit(1)).alias("part"), F.max("doc_id").alias("part_keep"),
                                            label.alias("part_label"))
    groups = parts.groupBy(*key).agg(F.sum("part").alias("size"), F.max("part_keep").alias("keep_id"),
                                     F.max("part_label").alias("label")).filter("size > 1")
    named = parts.select(*key, "salt").join(groups, key)
    new_group = F.col("digit") if first else F.col("label").cast("string").cast("binary")
    open_ = F.col("size").isNotNull() & ~F.col("ended")
    return keyed.drop("grp" if first else "rid").join(named, [*key, "salt"], "left").select(
        "doc_id", F.when(F.col("size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1)).cast("long").alias("group_size"), "text_sha256", (~open_).alias("settled"),
        F.when(open_, F.col("body")).alias("body"), F.when(open_, new_group).alias("grp"),
        F.monotonically_increasing_id().alias("rid"))
