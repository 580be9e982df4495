"""Digests: content ids, rendezvous scores, keyed hashes. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX, FLIPPED = "0123456789abcdef", "fedcba9876543210"


def content_id(data: Column) -> Column:
    """Hex SHA-256 of the bytes."""
    return F.sha2(data, 256)


def etag(data: Column) -> Column:
    return F.concat(F.lit('"'), F.sha2(data, 256), F.lit('"'))


def is_chunk_id(c: Column) -> Column:
    return c.rlike("^[0-9a-f]{64}$")


def score(key: Column, node: Column) -> Column:
    """Rendezvous score as 16 hex digits: their order as text is the unsigned order of the first eight bytes."""
    return F.substring(F.sha2(F.concat(key, F.lit("|"), node), 256), 1, 16)


def descending(hexadecimal: Column) -> Column:
    """Digits flipped, so that ascending order of it is descending order of the score."""
    return F.translate(hexadecimal, HEX, FLIPPED)


def hmac_sha256(secret: bytes, message: Column) -> Column:
    """Hex HMAC-SHA256 of a text, composed from two hashes over binary."""
    import hashlib

    key = hashlib.sha256(secret).digest() if len(secret) > 64 else secret
    key = key.ljust(64, b"\0")
    inner = F.unhex(F.lit(bytes(b ^ 0x36 for b in key).hex()))
    outer = F.unhex(F.lit(bytes(b ^ 0x5C for b in key).hex()))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256))), 256)
