"""Alert table: append, listing, labels, explanation and triage reports."""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.skew import BLOCK_ROWS, join_on, row_blocks, time_blocks, trailing_sums
from tidewatch.schema import ALERT, ALERT_LABELS
from tidewatch.session import scratch_path, settle

# Size of the recent set, of a similar list, of a listing and of a notification.
RECENT, SIMILAR, PAGE, MAX_PAGE, NOTIFY = 200, 5, 100, 1000, 10
# Recurrences over time run in blocks of so many seconds: as many rows a key at most.
BLOCK_SECONDS = 1_000_000


def to_alerts(anomalies: DataFrame, created_at: Column) -> DataFrame:
    """Anomalies as alert rows; the id depends on content only, so a replay writes the same row.

    The event is part of the content: two events of one key at one instant are two alerts.
    """
    content = F.concat_ws("|", "detector", "metric_key", F.unix_micros("ts").cast("string"), F.col("event_id").cast("string"))
    new_id = F.concat(F.lit("al_"), F.substring(F.sha2(content, 256), 1, 16))
    return anomalies.withColumns({"id": new_id, "created_at": created_at, "label": F.lit(None).cast("string")})


def full_alerts(found: DataFrame, events: DataFrame, created_at: Column) -> DataFrame:
    """Anomalies, or fused verdicts, as complete rows of the alert table: with source, severity and the event itself.

    ``found`` has event_id, detector, metric_key, value, baseline and score; anomalies have ``ts_seen`` and ``explanation`` too.
    Verdicts (``is_anomaly``) that found nothing are left out.  ``events`` has one row per event_id; an anomaly whose event is
    not there keeps its place with these columns null.
    """
    if "is_anomaly" in found.columns:
        found = found.where("is_anomaly")
    own = events.select("event_id", F.col("ts").alias("_ts"), F.col("source").alias("_source"), F.col("severity").alias("_severity"),
                        F.to_json(F.struct(*[c for c in events.columns])).alias("raw_event"))
    rows = found.join(own, "event_id", "left")
    seen = F.unix_micros("_ts") / F.lit(1e6)
    said = F.format_string("%s scored %.6g at %.6g, expected %.6g", "detector", "score", "value", "baseline")
    have = set(found.columns)
    rows = rows.withColumns({
        "ts": F.col("ts") if "ts" in have else F.col("_ts"),
        "ts_seen": F.coalesce(F.col("ts_seen"), seen) if "ts_seen" in have else seen,
        "explanation": F.coalesce(F.col("explanation"), said) if "explanation" in have else said,
        "source": F.col("_source"), "severity": F.col("_severity"),
    })
    return to_alerts(rows, created_at).select(*ALERT.names)


def list_alerts(alerts: DataFrame, since=None, source=None, severity=None, limit: int = PAGE) -> DataFrame:
    """Newest first; ``limit`` between 1 and 1000."""
    if not 1 <= limit <= MAX_PAGE:
        raise ValueError(f"limit must lie between 1 and {MAX_PAGE}")
    if since is not None:
        alerts = alerts.where(F.col("created_at") >= F.lit(since).cast("timestamp"))
    if source is not None:
        alerts = alerts.where(F.col("source") == source)
    if severity is not None:
        alerts = alerts.where(F.col("severity") == severity)
    return alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def alert_by_id(alerts: DataFrame, alert_id: str) -> DataFrame:
    return alerts.where(F.col("id") == alert_id)


def valid_labels(log: DataFrame) -> DataFrame:
    return log.where(F.col("label").isin(*ALERT_LABELS))


def apply_labels(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Latest accepted label per alert from an append-only log (alert_id, label, labelled_at)."""
    latest = valid_labels(log).groupBy("alert_id").agg(F.max(F.struct("labelled_at", "label")).alias("l"))
    latest = latest.select(F.col("alert_id").alias("id"), F.col("l.label").alias("_new"))
    out = alerts.join(latest, "id", "left")
    return out.withColumn("label", F.coalesce("_new", "label")).drop("_new").select(*alerts.columns)


def unknown_labels(alerts: DataFrame, log: DataFrame) -> DataFrame:
    """Log rows whose alert does not exist."""
    return log.join(alerts.select(F.col("id").alias("alert_id")), "alert_id", "left_anti")


def explain(alerts: DataFrame) -> DataFrame:
    """Deviation, explanation and up to five similar alerts (same key, among the newest 200) of every alert."""
    newest = alerts.orderBy(F.desc("created_at"), F.desc("id")).limit(RECENT).select("id", "metric_key", "created_at")
    # At most 200 rows feed this, so the arrays and the broadcast are bounded;
    # one more than needed is kept because an alert is not similar to itself.
    recent = newest.groupBy("metric_key").agg(
        F.slice(F.sort_array(F.collect_list(F.struct("created_at", "id")), asc=False), 1, SIMILAR + 1).alias("_recent")
    )
    out = alerts.join(F.broadcast(recent), "metric_key", "left")
    others = F.filter("_recent", lambda r: r["id"] != F.col("id"))
    similar = F.transform(F.slice(others, 1, SIMILAR), lambda r: r["id"])
    return out.select(
        "id", "metric_key", "value", "baseline", (F.col("value") - F.col("baseline")).alias("delta"), "score",
        (F.col("explanation") if "explanation" in alerts.columns else F.lit(None).cast("string")).alias("explanation"),
        F.coalesce(similar, F.array().cast("array<string>")).alias("similar"),
    )


def source_health(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy(F.coalesce("source", F.lit("unknown")).alias("source")).agg(
        F.max("created_at").alias("last_seen"), F.count(F.lit(1)).alias("count"))


def alerts_per_key(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("metric_key").agg(F.count(F.lit(1)).alias("n"))


def top_keys(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts_per_key(alerts).orderBy(F.desc("n"), "metric_key").limit(n)


def detector_precision(alerts: DataFrame) -> DataFrame:
    """Totals, false positives and precision (true over labelled true or false) per detector."""
    tp, fp = F.count_if(F.col("label") == "true_positive"), F.count_if(F.col("label") == "false_positive")
    return alerts.groupBy("detector").agg(
        F.count(F.lit(1)).alias("total"), tp.alias("true_positives"), fp.alias("false_positives"),
        F.try_divide(tp, tp + fp).alias("precision"))


def loudest_false_positives(alerts: DataFrame) -> DataFrame:
    """The metric key with most false positives per detector."""
    n = alerts.where(F.col("label") == "false_positive").groupBy("detector", "metric_key").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("detector").agg(F.max(F.col("n")).alias("n"), F.max_by("metric_key", F.struct("n", "metric_key")).alias("metric_key"))
    return best.select("detector", "metric_key", "n")


def anomaly_rate(events: DataFrame, alerts: DataFrame) -> DataFrame:
    """Share of events that became alerts, per source."""
    n = events.groupBy("source").agg(F.count(F.lit(1)).alias("events"))
    a = alerts.groupBy("source").agg(F.count(F.lit(1)).alias("anomalies"))
    out = n.join(a, "source", "left").withColumn("anomalies", F.coalesce("anomalies", F.lit(0)))
    return out.withColumn("rate", F.col("anomalies") / F.col("events"))


def failed_logins(events: DataFrame) -> DataFrame:
    """Refused logins of the application by address and user, most frequent first by count."""
    bad = events.where((F.col("source") == "app") & (F.col("status") == 401) & F.col("path").contains("login"))
    return bad.groupBy("src_ip", "user").agg(F.count(F.lit(1)).alias("n"))


def brute_force_windows(events: DataFrame, window: str = "5 minutes", min_failures: int = 20, min_users: int = 10, max_ips: int = 30) -> DataFrame:
    """Windows with many refusals over many users from few addresses; deduplicated before counting."""
    bad = events.where(F.col("status") == 401).withColumn("window_start", F.window("ts", window)["start"])
    pairs = bad.groupBy("window_start", "src_ip", "user").agg(F.count(F.lit(1)).alias("n"))
    cell = F.inline(F.array(
        F.struct(F.lit("u").alias("dim"), F.col("user").alias("val"), F.col("n").alias("c")),
        F.struct(F.lit("i").alias("dim"), F.col("src_ip").alias("val"), F.lit(0).cast("long").alias("c"))))
    values = pairs.select("window_start", cell).groupBy("window_start", "dim", "val").agg(F.sum("c").alias("c"))
    out = values.groupBy("window_start").agg(
        F.sum("c").alias("failures"),
        F.count_if((F.col("dim") == "u") & F.col("val").isNotNull()).alias("users"),
        F.count_if((F.col("dim") == "i") & F.col("val").isNotNull()).alias("ips"))
    return out.where((F.col("failures") >= min_failures) & (F.col("users") >= min_users) & (F.col("ips") <= max_ips))


def target_breadth(events: DataFrame, few: int = 3) -> DataFrame:
    """Per address: how many users its refused logins hit, and whether that is takeover or stuffing."""
    pairs = failed_logins(events)
    out = pairs.groupBy("src_ip").agg(F.sum("n").alias("failures"), F.count(F.lit(1)).alias("users"))
    return out.withColumn("shape", F.when(F.col("users") <= few, "account-takeover").otherwise("stuffing"))


def over_rate_limit(events: DataFrame, key: str, limit: int, seconds: int) -> DataFrame:
    """(key, second, requests, trailing) where the trailing count exceeds the limit.

    Counting per second first bounds every group by the seconds of its block,
    however many requests one address sends.
    """
    per = events.where(F.col(key).isNotNull()).groupBy(key, F.unix_seconds("ts").alias("second")).agg(F.count(F.lit(1)).alias("requests"))
    per = time_blocks(per, "second", max(3600, seconds), seconds)
    out = per.withColumns(trailing_sums([key, "_block"], "second", seconds, {"trailing": "requests"}))
    return out.where(~F.col("_halo") & (F.col("trailing") > limit)).select(key, "second", "requests", "trailing")


def admitted_requests(events: DataFrame, key: str, limit: int, seconds: int = 60, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """A limiter that does not count what it rejects: (key, second, requests, admitted).

    The recurrence runs over per-second counts, so one key brings at most one row per second.  Time is cut into blocks; a block
    whose first request comes more than ``seconds`` after the last one of the key starts anew, any other needs the last
    ``seconds`` of the block before.  Blocks are worked off by their distance from such a start, all keys side by side, and the
    admitted counts at their end are handed on.  A task streams the blocks of many keys one after another and holds the last
    ``seconds`` of one; there are as many rounds as the longest unbroken row of blocks, whatever the number of requests.
    """
    per = events.where(F.col(key).isNotNull()).groupBy(key, F.unix_seconds("ts").alias("second")).agg(F.count(F.lit(1)).alias("requests"))
    width = max(block_seconds, seconds + 1)
    per = settle(per.withColumn("_block", F.floor(F.col("second") / F.lit(width))))
    chain = Window.partitionBy(key).orderBy("_block")
    spans = per.groupBy(key, "_block").agg(F.min("second").alias("_first"), F.max("second").alias("_last"))
    anew = F.coalesce(F.col("_first") - F.lag("_last").over(chain) > seconds, F.lit(True))
    rounds = spans.withColumn("_run", F.sum(anew.cast("int")).over(chain))
    rounds = rounds.withColumn("_round", F.row_number().over(Window.partitionBy(key, "_run").orderBy("_block")) - 1)
    rounds = settle(rounds.select(F.col(key).alias("_key"), F.col("_block").alias("_b"), "_round"))
    rows = per.join(rounds, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b"))).select(per[key], "second", "requests", "_block", "_round")
    # a folder per round: each round reads its own rows only
    spark = events.sparkSession
    place, tasks = scratch_path(spark, "limiter"), spark.sparkContext.defaultParallelism
    rows.repartition(tasks, "_round", key).write.partitionBy("_round").parquet(place)
    stored = spark.read.schema(rows.schema).parquet(place)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # rows come by group and second; what is held are the admitted counts of the last ``seconds``
        past, used = deque(), 0
        for pdf in batches:
            admitted = []
            for at, second, requests, known in zip(*(pdf[c].tolist() for c in ("_at", "second", "requests", "admitted"))):
                if at == 1:
                    past.clear()
                    used = 0
                while past and second - past[0][0] > seconds:
                    used -= past.popleft()[1]
                admitted.append(min(requests, limit - used) if known < 0 else known)
                used += admitted[-1]
                past.append((second, admitted[-1]))
            yield pdf.drop(columns="_at").assign(admitted=admitted)[pdf["admitted"] < 0]

    schema = f"`{key}` {per.schema[key].dataType.simpleString()}, second long, requests long, _block long, admitted long"
    out, done = None, None
    for n in range((rounds.agg(F.max("_round")).first()[0] or 0) + 1):
        open_ = stored.where(F.col("_round") == n).drop("_round").withColumn("admitted", F.lit(-1).cast("long"))
        if done is not None:
            tail = done.where((F.col("_block") + 1) * width - F.col("second") <= seconds).withColumn("_block", F.col("_block") + 1)
            wanted = open_.select(F.col(key).alias("_key"), F.col("_block").alias("_b")).distinct()
            tail = tail.join(wanted, (F.col(key) == F.col("_key")) & (F.col("_block") == F.col("_b")), "left_semi")
            open_ = open_.unionByName(tail)
        group = Window.partitionBy(key, "_block").orderBy("second")
        ordered = open_.repartition(tasks, key, "_block").withColumn("_at", F.row_number().over(group))
        done = settle(ordered.mapInPandas(run, schema))
        out = done if out is None else out.unionByName(done)
    return out.drop("_block")


def without_repeats(alerts: DataFrame, minutes: int, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Alerts whose predecessor on the same key is more than ``minutes`` older."""
    b = row_blocks(alerts.withColumn("ts", F.col("created_at")), ["metric_key"], "ts", ["ts", "id"], 1, block_rows)
    w = Window.partitionBy("metric_key", "_block").orderBy("ts", "id")
    gap = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(w))
    out = b.withColumn("_gap", gap).where(~F.col("_halo"))
    return out.where(F.col("_gap").isNull() | (F.col("_gap") > minutes * 60_000_000)).select(*alerts.columns)


def with_cooldown(alerts: DataFrame, minutes: int, block_seconds: int = BLOCK_SECONDS) -> DataFrame:
    """(metric_key, second, id) of alerts emitted when each silences its key for ``minutes``.

    Time counts in whole seconds; the first alert (by id) of a second stands for it.  Time is cut into blocks of at least the
    silence.  Where a block is entered depends on the last alert emitted before it, and only the alerts of its first ``minutes``
    can be the entry.  So each block is summed up by the alert that it ends with for every possible entry; these jumps from
    block to block are followed in doubled steps, and every block then emits from the entry that was reached.  A task sees one
    block of a key, and the number of rounds is the logarithm of the number of blocks.
    """
    first = alerts.groupBy("metric_key", F.unix_seconds("created_at").alias("second")).agg(F.min("id").alias("id"))
    quiet = minutes * 60
    width = max(block_seconds, quiet + 1)
    rows = settle(first.withColumn("_block", F.floor(F.col("second") / F.lit(width))))

    def summary(pdf: pd.DataFrame) -> pd.DataFrame:
        sec = np.sort(pdf["second"].to_numpy())
        after = np.searchsorted(sec, sec + quiet, side="right").tolist()
        last = list(range(len(sec)))
        for i in range(len(sec) - 1, -1, -1):
            if after[i] < len(sec):
                last[i] = last[after[i]]
        block = int(pdf["_block"].iloc[0])
        n = min(len(sec), int(np.searchsorted(sec, block * width + quiet, side="right")) + 1)
        return pd.DataFrame({"metric_key": pdf["metric_key"].iloc[0], "_block": block, "entry": sec[:n], "leave": sec[last[:n]] + quiet})

    entries = settle(rows.groupBy("metric_key", "_block").applyInPandas(summary, "metric_key string, _block long, entry long, leave long"))
    chain = Window.partitionBy("metric_key").orderBy("_block")
    ahead = [F.lead(c, k).over(chain).alias(f"{c}_{k}") for k in (1, 2) for c in ("_block", "_first")]
    blocks = settle(entries.groupBy("metric_key", "_block").agg(F.min("entry").alias("_first")).select("*", *ahead))
    same = ["metric_key", "_block"]
    leaving = join_on(entries, blocks, same).where("_block_1 is not null")
    # the first entry of the next block behind the silence; if there is none, the first alert of the block after that
    marks = leaving.select("metric_key", F.col("_block_1").alias("_into"), F.col("leave").alias("at"), F.lit(1).alias("kind"), F.struct(
        "_block", "entry", "_block_2", "_first_2").alias("jump"), F.lit(None).cast("long").alias("entry"))
    marks = marks.unionByName(entries.select("metric_key", F.col("_block").alias("_into"), F.col("entry").alias("at"), F.lit(0).alias("kind"),
                                             F.lit(None).cast(marks.schema["jump"].dataType).alias("jump"), "entry"))
    behind = Window.partitionBy("metric_key", "_into").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = marks.withColumn("next", F.min("entry").over(behind)).where("kind = 1")
    jumps = settle(found.select(
        "metric_key", F.col("jump._block").alias("_block"), F.col("jump.entry").alias("entry"),
        F.when(F.col("next").isNotNull(), F.struct(F.col("_into").alias("b"), F.col("next").alias("e")))
        .when(F.col("jump._block_2").isNotNull(), F.struct(F.col("jump._block_2").alias("b"), F.col("jump._first_2").alias("e"))).alias("to"),
    ).where("to is not null"))
    start = blocks.groupBy("metric_key").agg(F.min_by(F.struct("_block", F.col("_first").alias("entry")), "_block").alias("s"))
    reached = settle(start.select("metric_key", "s._block", "s.entry"))
    place, n = ["metric_key", "_block", "entry"], -1
    while n != (now := reached.count()):
        n = now
        step = join_on(reached, jumps, place).select("metric_key", F.col("to.b").alias("_block"), F.col("to.e").alias("entry"))
        reached = settle(reached.unionByName(step).distinct())
        onward = jumps.select("metric_key", F.col("to.b").alias("_block"), F.col("to.e").alias("entry"), F.struct("_block", "entry").alias("from"))
        jumps = settle(join_on(onward, jumps, place).select("metric_key", F.col("from._block").alias("_block"), F.col("from.entry").alias("entry"), "to"))

    def emitted(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("second")
        keep, until = [], None
        for s in pdf["second"]:
            keep.append(until is None or s > until)
            until = s + quiet if keep[-1] else until
        return pdf[keep]

    live = join_on(rows, reached, same).where(F.col("second") >= F.col("entry")).drop("entry")
    return live.groupBy("metric_key", "_block").applyInPandas(emitted, "metric_key string, second long, id string, _block long").drop("_block")


def platform_events(alerts: DataFrame, window: str = "5 minutes", min_hosts: int = 50) -> DataFrame:
    """Windows in which one detector and signal fire on many hosts: one event instead of many alerts."""
    parts = F.split("metric_key", ":")
    hosts = alerts.select(
        F.window("created_at", window)["start"].alias("window_start"), "detector",
        F.element_at(parts, -1).alias("signal"), F.concat_ws(":", parts[0], parts[1]).alias("host")).distinct()
    n = hosts.groupBy("window_start", "detector", "signal").agg(F.count(F.lit(1)).alias("hosts"))
    return n.where(F.col("hosts") >= min_hosts)


def attack_recall(anomalies: DataFrame, attacks: DataFrame, window: str = "5 minutes") -> DataFrame:
    """Per injected attack: attacked windows of (source, host) and how many hold an anomaly.

    Both sides are reduced to distinct windows before the join.
    """
    win = F.window("ts", window)["start"].alias("window_start")
    hit = anomalies.select("source", "host", win).distinct().withColumn("hit", F.lit(1))
    want = attacks.select("attack", "source", "host", win).distinct()
    out = want.join(hit, ["source", "host", "window_start"], "left")
    return out.groupBy("attack").agg(F.count(F.lit(1)).alias("windows"), F.count("hit").alias("detected"))


def top_contributors(features: DataFrame, base: DataFrame, keys, names, n: int = 3) -> DataFrame:
    """The ``n`` features furthest from their baseline per row: (keys, rank, feature, observed, baseline, z).

    ``base`` has one row per feature (feature, mean, std); ranking happens
    inside each row, without a shuffle.
    """
    wide = base.groupBy().agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("mean", "std")))).alias("_base"))
    out = features.join(F.broadcast(wide))  # one row
    cells = []
    for f in names:
        b = F.try_element_at("_base", F.lit(f))
        z = (F.col(f) - b["mean"]) / b["std"]
        cells.append(F.struct((-F.abs(z)).alias("o"), F.lit(f).alias("feature"), F.col(f).alias("observed"), b["mean"].alias("baseline"), z.alias("z")))
    ranked = F.slice(F.array_sort(F.filter(F.array(*cells), lambda c: c["z"].isNotNull())), 1, n)
    out = out.select(*keys, F.posexplode(ranked).alias("pos", "c"))
    return out.select(*keys, (F.col("pos") + 1).alias("rank"), "c.feature", "c.observed", "c.baseline", "c.z")


def notifications(anomalies: DataFrame, n: int = NOTIFY) -> DataFrame:
    """The first ``n`` anomalies in event order, which is all a batch announces."""
    return anomalies.orderBy("ts", "event_id", "rule_ord").limit(n)
