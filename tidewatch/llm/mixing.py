"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key, stored, text_or_empty, word_count

MAX_EPOCHS = 3
#: Three hex digits of the seeded hash: each source is cut into so many slices for running sums.
SLICE_DIGITS = 3


def source_targets(sizes: DataFrame, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """(source, source_size, target, epochs, extra): how many words the mix takes of each source.

    Sources in code-point order, null last, weigh 1, 2, 3, repeating.  All words of the table are shared by weight; a source
    stops at ``max_epochs`` times its size, and what it cannot take goes to the others by weight, until none is above.  The
    sources that end up clamped are those of least capacity per unit of weight, so one ordered pass with running sums finds
    them: a source is clamped while its capacity is below what the level left by the clamped ones before it would give it.
    Works on one row per source.
    """
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    by_room = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_room.rowsBetween(Window.unboundedPreceding, -1)
    everything = by_room.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    wide = "decimal(38,0)"
    ranked = total.withColumn("weight", F.pmod(F.row_number().over(by_name) - 1, F.lit(3)).cast("long") + 1) \
                  .withColumn("cap", F.col("source_size") * max_epochs)
    levelled = ranked.withColumns({
        "words_left": F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0)),
        "weight_left": F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0)),
    }).withColumn("clamped", F.col("cap").cast(wide) * F.col("weight_left") < F.col("words_left").cast(wide) * F.col("weight"))
    free = levelled.withColumns({
        "rest": F.sum("source_size").over(everything)
        - F.coalesce(F.sum(F.when(F.col("clamped"), F.col("cap"))).over(everything), F.lit(0)),
        "rest_weight": F.sum(F.when(~F.col("clamped"), F.col("weight"))).over(everything),
    })
    target = F.when(F.col("clamped"), F.col("cap").cast("double")).otherwise(
        (F.col("weight") * F.col("rest")).cast("double") / F.col("rest_weight").cast("double"))
    epochs = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(F.col("target") / F.col("source_size")))
    return free.withColumn("target", target).withColumn("epochs", epochs.cast("long")) \
        .withColumn("extra", F.col("target") - (F.col("epochs") * F.col("source_size")).cast("double")) \
        .select("source", "source_size", "target", "epochs", "extra")


def mix(docs: DataFrame, seed: int = 1, max_epochs: int = MAX_EPOCHS, name: Column | None = None) -> DataFrame:
    """Repetitions of each document in the mix: (doc_id, size, source, source_size, target, repeats, taken), and its ``name`` if one is given.

    Every document of a source is taken ``floor(target / source_size)`` times.  What is still missing is filled with one more
    repetition of documents in the order of a seeded hash of the id, up to the document that would cross the missing amount
    with more than half of its words; so each source ends within half a document of its target, and reruns agree.

    The running sum over a source, which may hold a third of the rows, is taken over slices of the hash: sums per slice first,
    then single rows only in the one slice of each source where the amount is reached.

    Null text has size 0; such documents are taken with their source and add nothing.  Null sources are one source, the last.
    A null id is hashed as an empty one.  Rows that repeat an id are taken one by one.  Only doc_id, text and source are read.
    An empty table gives an empty mix.
    """
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("doc_id").cast("string")))
    sizes = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
                               word_count(text_or_empty()).alias("size"), key.alias("order_key"), *([] if name is None else [name.alias("name")]))
                   .withColumn("slice", F.substring("order_key", 1, SLICE_DIGITS)), "mix-sizes")
    return _repeats(sizes, stored(source_targets(sizes, max_epochs), "mix-targets"))


def _repeats(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    slices = sizes.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    slices = join_by_key(slices, targets, ["source"], "slice", 8)
    reached = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice"))
    slices = slices.withColumn("upto", reached).withColumn("start", F.col("upto") - F.col("slice_size")) \
        .select(F.col("source").alias("_source"), F.col("slice").alias("_slice"), "source_size", "target", "epochs", "extra",
                "start", "upto")
    rows = sizes.join(slices, F.col("source").eqNullSafe(F.col("_source")) & (F.col("slice") == F.col("_slice"))) \
        .drop("_source", "_slice")
    edge = (F.col("start") < F.col("extra")) & (F.col("upto") > F.col("extra"))
    running = Window.partitionBy("source").orderBy("order_key", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    at_edge = rows.filter(edge).withColumn("ahead", F.col("start") + F.coalesce(F.sum("size").over(running), F.lit(0))) \
        .withColumn("more", (2 * F.col("ahead") + F.col("size")).cast("double") < 2 * F.col("extra"))
    clear = rows.filter(~edge).withColumn("ahead", F.col("start")).withColumn(
        "more", (F.col("upto") <= F.col("extra")) & (F.col("extra") > 0))
    out = clear.unionByName(at_edge).withColumn("repeats", F.col("epochs") + F.col("more").cast("long"))
    return out.select("doc_id", "size", "source", "source_size", "target", "repeats",
                      (F.col("size") * F.col("repeats")).alias("taken"), *[c for c in sizes.columns if c == "name"])


def mixed_documents(docs: DataFrame, seed: int = 1, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """The mix itself: every row of ``docs`` as often as ``mix`` says, with its own columns only.

    The repetitions are joined back by a name, the hash of id, text and source: rows that share an id, or have none, have counts
    of their own, and rows alike in all of these share one.
    """
    name = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text", "source")
    rows = docs.select(F.struct("*").alias("row"), name.alias("name"))
    plan = mix(docs, seed, max_epochs, name) \
        .groupBy(F.col("name").alias("mixed")).agg(F.max("repeats").alias("repeats"))
    joined = rows.join(plan, F.col("name") == F.col("mixed")).filter("repeats > 0")
    return joined.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("repeats")))).select(*[F.col("row")[c].alias(c) for c in docs.columns])
