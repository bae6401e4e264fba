"""Digests, HMAC-SHA256 and hash chains with built-in functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lowercase hex HMAC-SHA256 of a text's UTF-8."""
    k = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner = F.sha2(F.concat(F.lit(bytes(x ^ 0x36 for x in k)), F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(F.lit(bytes(x ^ 0x5C for x in k)), F.unhex(inner)), 256)


def text_digest(c: Column) -> Column:
    return F.sha2(F.encode(F.coalesce(c, F.lit("")), "UTF-8"), 256)


def folded_digest(c: Column) -> Column:
    """Of the lower-cased, trimmed text with single spaces."""
    return text_digest(F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"\s+", " ")))
