"""Column expressions shared by several operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.schema import METRIC_SOURCES

# Substrings that mark an authentication path.
AUTH_PATH_HINTS = ("login", "auth", "signin", "logon", "token")
# Field names that must not occur, and value patterns for phone and e-mail.
PII_FIELDS = ("name", "first_name", "last_name", "email", "phone", "address", "ssn", "dob")
PHONE_PATTERN = r"\b\d{3}[-. ]?\d{3}[-. ]?\d{4}\b"
EMAIL_PATTERN = r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}"
# Fixed value: words that mark a log line as an error.
ERROR_WORDS = r"(?i)\b(error|fail|denied|exception|panic|fatal|crash|timeout)\b"
# Fixed value: shapes of SQL injection and script payloads after URL decoding.
ATTACK_PAYLOAD = r"(?i)('\s*or\s+1\s*=\s*1|;\s*drop\s+table|union\s+select|<script)"
# Fixed value: a request at least this slow (ms) belongs to a slow-request attack.
SLOW_REQUEST_MS = 30_000


def status_in_class(status: Column, hundred: int) -> Column:
    return (status >= hundred * 100) & (status < (hundred + 1) * 100)


def auth_failure(severity: Column, path: Column) -> Column:
    failed = severity.isin("ERROR", "WARN") & path.rlike("|".join(AUTH_PATH_HINTS))
    return F.coalesce(failed, F.lit(False))


def value_has_pii(text: Column) -> Column:
    # The literal test spares most texts the backtracking e-mail search.
    email = text.contains("@") & text.rlike(EMAIL_PATTERN)
    return F.coalesce(email | text.rlike(PHONE_PATTERN), F.lit(False))


def has_error_word(text: Column) -> Column:
    return F.coalesce(text.rlike(ERROR_WORDS), F.lit(False))


def has_attack_payload(path: Column) -> Column:
    decoded = F.coalesce(F.try_url_decode(path), path)
    return F.coalesce(decoded.rlike(ATTACK_PAYLOAD), F.lit(False))


def from_country(attrs: Column, *codes: str) -> Column:
    """Does the event's ``attrs.country`` name one of the two-letter codes, in any case; false where there is none."""
    return F.coalesce(F.upper(F.get_json_object(attrs, "$.country")).isin(*[c.upper() for c in codes]), F.lit(False))


def metric_key(source: Column, host: Column, metric: Column, metric_value: Column,
               latency_ms: Column, status: Column) -> Column:
    """``source:host:signal`` of a scorable event, null if it carries no signal."""
    shown_host = F.when(F.coalesce(host, F.lit("")) == "", "?").otherwise(host)
    signal = (
        F.when(source.isin(*METRIC_SOURCES) & metric_value.isNotNull(), F.coalesce(metric, F.lit("?")))
        .when(latency_ms.isNotNull(), F.lit("latency_ms"))
        .when(status.isNotNull(), F.concat(F.lit("status_"), F.floor(status / 100).cast("string"), F.lit("xx")))
    )
    return F.when(signal.isNotNull(), F.concat_ws(":", source, shown_host, signal))


def metric_sample(source: Column, metric_value: Column, latency_ms: Column, status: Column) -> Column:
    return (
        F.when(source.isin(*METRIC_SOURCES) & metric_value.isNotNull(), metric_value)
        .when(latency_ms.isNotNull(), latency_ms)
        .when(status.isNotNull(), F.lit(1.0))
    )


def epoch_seconds(ts: Column) -> Column:
    return F.unix_micros(ts) / F.lit(1e6)
