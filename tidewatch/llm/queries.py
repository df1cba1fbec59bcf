"""The registered corpus queries and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

import corpus_pipeline
from tidewatch.llm import (bpe, exact_dedup, html_text, line_dedup, mixing, near_dedup, quality, resampling, sharding, spelling,
                           suffix_dedup, token_counts, url_filter)
from tidewatch.llm.common import table
from tidewatch.llm.vocabulary import production_vocabulary


def op1_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf, "documents"), *production_vocabulary())


def op2_minhash(spark: SparkSession, sf: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf, "documents"))


def op3_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf, "documents"))


def op4_label_propagation_shards(spark: SparkSession, sf: str) -> DataFrame:
    return sharding.balanced_shards(table(spark, sf, "documents"))


def op5_html_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op6_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf, "pages"), table(spark, sf, "labels"), inherit=True).drop("host_bound")


def op7_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents"), short=True)


def op8_mixing(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.judge(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_token_counts(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("edits", token_counts.derived_edits())
    return token_counts.counts_under_edits(docs, *production_vocabulary())


def op11_importance_resampling(spark: SparkSession, sf: str) -> DataFrame:
    return resampling.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    return spelling.spelling_forms(table(spark, sf, "documents"))


def op13_suffix_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return suffix_dedup.without_repeats(table(spark, sf, "documents"), with_bytes=False)


QUERIES = {f.__name__: f for f in (
    op1_byte_bpe, op2_minhash, op3_exact_dedup, op4_label_propagation_shards, op5_html_text, op6_url_filter, op7_line_dedup, op8_mixing, op9_quality_rules,
    op10_token_counts, op11_importance_resampling, op12_spelling_variants,
    op13_suffix_dedup)}

ORACLES = {
    "op3_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
               doc_id = max(doc_id) OVER g AS kept, sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""",
    "op8_mixing": r"""
        WITH RECURSIVE sizes AS (
            SELECT doc_id, source, md5(concat_ws(':', '1', doc_id::VARCHAR)) AS k,
                   len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
        sources AS (
            SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
            FROM sizes GROUP BY source),
        fill AS (
            SELECT source, source_size, w, false AS clamped, 0 AS step FROM sources
            UNION ALL
            SELECT source, source_size, w, clamped OR source_size * 3 < w * rest / rest_w, step + 1
            FROM (SELECT *, ((sum(source_size) OVER ()) - coalesce(sum(CASE WHEN clamped THEN 3 * source_size END) OVER (), 0))::DOUBLE AS rest,
                         (sum(CASE WHEN NOT clamped THEN w END) OVER ())::DOUBLE AS rest_w FROM fill)
            WHERE step < 40),
        last AS (SELECT * FROM fill WHERE step = 40),
        targets AS (
            SELECT source, source_size, CASE WHEN clamped THEN (3 * source_size)::DOUBLE ELSE
                (w * ((sum(source_size) OVER ()) - coalesce(sum(CASE WHEN clamped THEN 3 * source_size END) OVER (), 0)))::DOUBLE
                / (sum(CASE WHEN NOT clamped THEN w END) OVER ())::DOUBLE END AS target FROM last),
        plan AS (
            SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE floor(target / source_size)::BIGINT END AS epochs FROM targets),
        running AS (
            SELECT s.*, p.source_size, p.target, p.epochs, p.target - (p.epochs * p.source_size)::DOUBLE AS extra,
                   coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id
                                              ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ahead
            FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
        SELECT doc_id, size, source_size, target,
               (size * (epochs + CASE WHEN (2 * ahead + size)::DOUBLE < 2 * extra THEN 1 ELSE 0 END))::BIGINT AS taken
        FROM running""",
    "op6_url_filter": r"""
        WITH p AS (
            SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
        q AS (SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS raw, rest FROM p),
        r AS (SELECT page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                     regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM q),
        o AS (SELECT doc_id, max((quality = 0)::INT) AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
        h AS (
            SELECT host, count(*) AS n, sum(bad)::BIGINT AS k,
                   CASE WHEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (TWO)
                        THEN array_to_string(list_slice(string_split(host, '.'), -2, -1), '.')
                        ELSE list_extract(string_split(host, '.'), -1) END AS suffix,
                   array_to_string(list_slice(string_split(host, '.'), CASE WHEN
                        array_to_string(list_slice(string_split(host, '.'), -2, -1), '.') IN (TWO) THEN -3 ELSE -2 END, -1), '.') AS domain
            FROM r JOIN o ON r.page_id = o.doc_id WHERE host <> '' GROUP BY host),
        d AS (SELECT domain, suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM h GROUP BY domain, suffix),
        s AS (SELECT suffix, sum(n)::BIGINT AS n, sum(k)::BIGINT AS k FROM d GROUP BY suffix),
        g AS (SELECT sum(k)::DOUBLE / sum(n) AS rate FROM s),
        levels AS (SELECT 's' AS level, 'all' AS parent, n, k FROM s UNION ALL SELECT 'd', suffix, n, k FROM d
                   UNION ALL SELECT 'h', domain, n, k FROM h),
        parents AS (
            SELECT level, sum(n)::DOUBLE AS pn, sum(k) / sum(n)::DOUBLE AS rate, count(*) AS c, sum(n * n)::DOUBLE AS nn,
                   sum(k)::DOUBLE AS pk, sum((k * k)::DOUBLE / n) AS kk FROM levels GROUP BY level, parent HAVING count(*) > 1),
        spread AS (
            SELECT level, sum(kk - pk * rate - (c - 1) * rate * (1 - rate)) AS over,
                   sum((pn - nn / pn - (c - 1)) * rate * (1 - rate)) AS unit FROM parents GROUP BY level),
        m AS (
            SELECT l.level, coalesce(CASE WHEN unit > 0 AND round(over / unit, 6) > 0
                        THEN greatest(2.0::DOUBLE, least(200.0::DOUBLE, 1 / round(over / unit, 6) - 1)) END, 200.0::DOUBLE) AS m
            FROM (VALUES ('s'), ('d'), ('h')) l(level) LEFT JOIN spread USING (level)),
        sm AS (SELECT suffix, (k + m * rate) / (n + m) AS mean FROM s, g, m WHERE level = 's'),
        dm AS (SELECT domain, (k + m * mean) / (n + m) AS mean FROM d JOIN sm USING (suffix), m WHERE level = 'd'),
        ab AS (SELECT host, k + m * mean AS a, n - k + m * (1 - mean) AS b FROM h JOIN dm USING (domain), m WHERE level = 'h'),
        rep AS (SELECT host, a / (a + b) - 1.645 * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM ab),
        judged AS (
            SELECT r.*, rep.bound, CASE
                WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/de/%' THEN 'example.com/de/'
                WHEN (host = 'example.net' OR host LIKE '%.example.net') AND path LIKE '/en/%' THEN 'example.net/en/'
                WHEN (host = 'org' OR host LIKE '%.org') AND path LIKE '/fr/%' THEN 'org/fr/'
                WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/%' THEN 'net/' END AS rule
            FROM r LEFT JOIN rep USING (host))
        SELECT page_id, host, path, rule, CASE
            WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
            WHEN bound > 0.5 THEN 'block' ELSE 'allow' END AS verdict
        FROM judged""".replace("TWO", ", ".join(f"'{x}'" for x in url_filter.TWO_LABEL_SUFFIXES)),
}


def queries():
    return QUERIES | {"pipeline": corpus_pipeline.run}


def oracles():
    return ORACLES | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
