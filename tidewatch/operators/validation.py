"""Input validation: row-count gate and personal-data scan over every row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.functions.expressions import PII_FIELDS, value_has_pii

NAME_REASON = "field name in PII list"
VALUE_REASON = "value matches PII pattern"


def _hits(df: DataFrame) -> Column:
    found = []
    for f in df.schema.fields:
        if f.name.lower() in PII_FIELDS:
            found.append(F.struct(F.lit(f.name).alias("field"), F.lit(NAME_REASON).alias("reason")))
        if isinstance(f.dataType, T.StringType):
            hit = F.struct(F.lit(f.name).alias("field"), F.lit(VALUE_REASON).alias("reason"))
            found.append(F.when(value_has_pii(F.col(f.name)), hit))
    empty = F.array().cast("array<struct<field: string, reason: string>>")
    return F.filter(F.array(*found), lambda h: h.isNotNull()) if found else empty


def pii_hits(df: DataFrame, row_id: str) -> DataFrame:
    """(row, field, reason): one hit per listed field name and per matching text value."""
    return df.select(F.col(row_id).alias("row"), F.inline(_hits(df)))


def pii_keys(df: DataFrame, attrs: str) -> DataFrame:
    """(field, n): listed names among the keys of a map column, compared without case."""
    keys = df.select(F.explode(F.map_keys(attrs)).alias("field"))
    return keys.where(F.lower("field").isin(*PII_FIELDS)).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def validation_report(df: DataFrame, min_rows: int = 100) -> DataFrame:
    """One row: row_count, min_rows_required, pii_violation_count, passed; one scan of all rows."""
    out = df.select(F.size(_hits(df)).alias("n")).agg(
        F.count(F.lit(1)).alias("row_count"), F.coalesce(F.sum("n"), F.lit(0)).alias("pii_violation_count"))
    ok = (F.col("row_count") >= min_rows) & (F.col("pii_violation_count") == 0)
    return out.select("row_count", F.lit(min_rows).alias("min_rows_required"), "pii_violation_count", ok.alias("passed"))


def first_violations(df: DataFrame, row_id: str, n: int = 50) -> DataFrame:
    """The listing of a report: the first ``n`` hits in row order."""
    return pii_hits(df, row_id).orderBy("row", "field", "reason").limit(n)
