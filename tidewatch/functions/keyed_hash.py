"""Keyed pseudonyms from built-in hashes."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sources in which the address itself is the signal and stays readable.
RAW_ADDRESS_SOURCES = ("waf", "cloudfront")
# Block size and pad bytes of the standard keyed-hash construction.
_BLOCK, _INNER, _OUTER = 64, 0x36, 0x5C


def hmac_sha256(text: Column, key: bytes) -> Column:
    """Hexadecimal HMAC-SHA256 of a string column; only the two padded keys are computed outside Spark.

    The padded keys are literals of the plan: whoever may read plans or event logs of the job can read the key.
    """
    key = hashlib.sha256(key).digest() if len(key) > _BLOCK else key
    key = key.ljust(_BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in key)) for pad in (_INNER, _OUTER))
    first = F.unhex(F.sha2(F.concat(inner, text.cast("binary")), 256))
    return F.sha2(F.concat(outer, first), 256)


def pseudonymise(events: DataFrame, key: bytes) -> DataFrame:
    """Replace ``user`` everywhere and ``src_ip`` outside the address-based sources."""
    keep = F.col("source").isin(*RAW_ADDRESS_SOURCES)
    return events.withColumns({
        "user": hmac_sha256(F.col("user"), key),
        "src_ip": F.when(keep, F.col("src_ip")).otherwise(hmac_sha256(F.col("src_ip"), key)),
    })
