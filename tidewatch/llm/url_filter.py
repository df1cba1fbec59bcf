"""URL filters: fixed rules first, then host reputation by empirical Bayes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import join_by_key, stored

#: (rule, verdict) pairs; a rule is a host and a path in one string.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Suffixes of two labels under which names are registered; other suffixes are the last label.
TWO_LABEL_SUFFIXES = ("co.uk", "org.uk", "ac.uk", "gov.uk", "com.au", "net.au", "org.au", "co.nz", "co.jp", "ne.jp", "or.jp",
                      "co.kr", "com.br", "com.mx", "com.ar", "com.tr", "com.cn", "com.tw", "co.in", "co.za", "com.sg")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A host is blocked if its share of bad pages exceeds BAD_SHARE with the one-sided confidence of Z standard deviations.
BAD_SHARE = 0.5
Z = 1.645
#: Prior strengths (in pages) are kept within these bounds, so that neither a single page nor a flat history decides alone.
STRENGTH = (2.0, 200.0)


def url_parts(url: Column) -> tuple[Column, Column]:
    """Host and path: empty for a null url or one without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(F.coalesce(at, F.lit(0)) > 0, url.substr(at + 3, F.length(url))).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest.substr(F.length(raw) + 1, F.length(rest) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, UPPER.lower()), path


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null where none fits.  Rules come as a parameter, tens of them at most."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def registered_domain(host: Column) -> tuple[Column, Column]:
    """Registered domain and suffix of a host."""
    labels = F.split(host, r"\.")
    two = F.substring_index(host, ".", -2)
    suffix = F.when(two.isin(*TWO_LABEL_SUFFIXES), two).otherwise(F.substring_index(host, ".", -1))
    depth = F.when(two.isin(*TWO_LABEL_SUFFIXES), 3).otherwise(2)
    return F.array_join(F.slice(labels, -F.least(depth, F.size(labels)), F.least(depth, F.size(labels))), "."), suffix


def _strength(children: DataFrame, by: list[str], n: str, k: str) -> DataFrame:
    """How many pages the parent's rate is worth for its children: beta-binomial moments over all children of the level.

    With rates p_i = k_i / n_i around the pooled rate p, the spread beyond binomial noise gives the intra-class correlation
    rho, and the prior strength is 1 / rho - 1.  One row; where nothing can be told apart the prior is as strong as allowed.
    """
    parent = children.groupBy(*by).agg(F.sum(n).alias("pn"), F.sum(k).alias("pk"), F.count(F.lit(1)).alias("g"),
                                       F.sum(F.col(n) * F.col(n)).alias("nn"),
                                       F.sum(F.col(k) * F.col(k) / F.col(n)).alias("kk")).filter("g > 1")
    rate = F.col("pk") / F.col("pn")
    within = parent.select(
        (F.col("kk") - F.col("pk") * rate - (F.col("g") - 1) * rate * (1 - rate)).alias("over"),
        ((F.col("pn") - F.col("nn") / F.col("pn") - (F.col("g") - 1)) * rate * (1 - rate)).alias("unit"))
    total = within.agg(F.sum("over").alias("over"), F.sum("unit").alias("unit"))
    rho = F.round(F.col("over") / F.col("unit"), 6)
    low, high = STRENGTH
    told = (F.col("unit") > 0) & (rho > 0)
    return total.select(F.when(told, F.greatest(F.lit(low), F.least(F.lit(high), 1 / rho - 1))).otherwise(F.lit(high))
                        .alias("strength"))


def host_reputation(outcomes: DataFrame, others: DataFrame | None = None) -> DataFrame:
    """(host, n, k, lower): a lower posterior bound on the share of bad pages of each host that has outcomes, or is in ``others``.

    ``others`` has distinct hosts; those without outcomes count n = k = 0 and take the posterior mean of their domain, else of
    their suffix, else the overall rate, each with the prior strength of the host level.  Without any outcome there is no bound.

    ``outcomes`` has host and bad (0/1).  Rates are shrunk from level to level: the overall rate is the prior of each suffix,
    the suffix's posterior mean that of each registered domain, the domain's that of each host; each level's prior strength is
    estimated from the spread of its children.  Counts are combined before they are shuffled, so a host with a third of the
    pages costs one row per task.
    """
    domain, suffix = registered_domain(F.col("host"))
    hosts = stored(outcomes.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum("bad").cast("long").alias("k"))
                   .withColumns({"domain": domain, "suffix": suffix}), "hosts")
    domains = hosts.groupBy("domain", "suffix").agg(F.sum("n").alias("dn"), F.sum("k").alias("dk"))
    suffixes = domains.groupBy("suffix").agg(F.sum("dn").alias("sn"), F.sum("dk").alias("sk"))
    overall = suffixes.agg((F.sum("sk") / F.sum("sn")).alias("rate"))
    one = overall.crossJoin(F.broadcast(_strength(suffixes.withColumn("all", F.lit(1)), ["all"], "sn", "sk")
                                        .withColumnRenamed("strength", "m_s"))) \
        .crossJoin(F.broadcast(_strength(domains, ["suffix"], "dn", "dk").withColumnRenamed("strength", "m_d"))) \
        .crossJoin(F.broadcast(_strength(hosts, ["domain"], "n", "k").withColumnRenamed("strength", "m_h")))
    one = one if others is None else stored(one, "url-priors")
    by_suffix = suffixes.crossJoin(F.broadcast(one)).withColumn("s_mean", _mean("sk", "sn", "rate", "m_s"))
    rates = domains.join(by_suffix, "suffix").withColumn("d_mean", _mean("dk", "dn", "s_mean", "m_d")) \
        .select("domain", "d_mean", "m_h")
    known = hosts.join(rates, "domain")
    if others is not None:
        new = others.join(hosts.select("host"), "host", "left_anti").select(
            "host", F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("k"), domain.alias("domain"), suffix.alias("suffix"))
        # one domain may have most of the new hosts: spread by host
        new = join_by_key(new, rates.select("domain", "d_mean"), ["domain"], "host", how="left")
        new = join_by_key(new, by_suffix.select("suffix", "s_mean"), ["suffix"], "host", how="left")
        new = new.crossJoin(F.broadcast(one.filter("rate is not null").select("rate", "m_h"))).withColumn(
            "d_mean", F.coalesce("d_mean", "s_mean", "rate"))
        known = known.select("host", "n", "k", "d_mean", "m_h").unionByName(new.select("host", "n", "k", "d_mean", "m_h"))
    a = F.col("k") + F.col("m_h") * F.col("d_mean")
    b = F.col("n") - F.col("k") + F.col("m_h") * (1 - F.col("d_mean"))
    lower = a / (a + b) - Z * F.sqrt(a * b / ((a + b) * (a + b) * (a + b + 1)))
    return known.select("host", "n", "k", lower.alias("lower"))


def _mean(k: str, n: str, prior: str, strength: str) -> Column:
    return (F.col(k) + F.col(strength) * F.col(prior)) / (F.col(n) + F.col(strength))


def filter_urls(pages: DataFrame, labels: DataFrame, rules: Sequence[tuple[str, str]] = RULES, inherit: bool = False) -> DataFrame:
    """(page_id, host, path, rule, verdict, host_bound), one row per page.

    The longest fitting rule decides; without one, a page is blocked if the reputation of its host says that more than
    ``BAD_SHARE`` of its pages are bad, at the posterior bound.  Outcomes are the labelled pages: label rows whose id is the
    page's id, bad if the quality label is 0 (the largest outcome, if an id has several; null labels are no outcome).  Hosts
    without outcomes are allowed, or with ``inherit``, as in the registered query, judged by their domain, its suffix or the overall
    rate.  Pages without a host have no reputation and are allowed.

    A null url has empty host and path.  Null page ids are judged by their url but match no label.  Repeated rows are judged
    one by one.  Only page_id and url are read of the pages.  An empty table gives no rows.
    """
    host, path = url_parts(F.col("url"))
    parsed = pages.select(F.col("page_id").cast("long").alias("page_id"), host.alias("host"), path.alias("path"))
    outcome = labels.filter("quality is not null and doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")) \
        .agg(F.max((F.col("quality") == 0).cast("int")).alias("bad"))
    named = parsed.filter("host <> ''")
    reputation = host_reputation(named.join(outcome, "page_id").select("host", "bad"), named.select("host").distinct() if inherit else None)
    judged = join_by_key(parsed, stored(reputation.select("host", F.col("lower").alias("host_bound")), "reputation"),
                         ["host"], "page_id", how="left")
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("host_bound") > BAD_SHARE, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, own).alias("verdict"), "host_bound")
