"""Identities of documents: content hashes, and the split and sampling keys taken from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

VALIDATION_SHARE = 10
U64_MAX = 2**64 - 1


def identity(url: Column, text: Column) -> Column:
    """The url unless it is null or empty, else the text."""
    return F.coalesce(F.nullif(url, F.lit("")), text)


def digest(value: Column) -> Column:
    """SHA-256 of the UTF-8 bytes, as lower-case hex."""
    return F.sha2(value.cast("binary"), 256)


def le_u64(hex_digest: Column, byte: int) -> Column:
    """Eight bytes of a hex digest from ``byte`` on, read as a little-endian unsigned integer: DECIMAL(20, 0)."""
    pairs = [F.substring(hex_digest, 2 * (byte + k) + 1, 2) for k in reversed(range(8))]
    return F.conv(F.concat(*pairs), 16, 10).cast("decimal(20,0)")


def is_validation(hex_digest: Column) -> Column:
    """One in ten, by the first eight bytes."""
    return le_u64(hex_digest, 0) % VALIDATION_SHARE == 0


def sample_key(hex_digest: Column) -> Column:
    return le_u64(hex_digest, 8)


def framed_bytes(text: Column) -> Column:
    """Bytes of the text and its newline."""
    return (F.octet_length(text) + 1).cast("long")


def sample_cutoff(target_bytes: int, corpus_bytes: int) -> int:
    """The greatest sample key of a training sample of about ``target_bytes``."""
    fraction = min(1.0, target_bytes / max(1.0, corpus_bytes * 0.9))
    return U64_MAX if fraction >= 1 else int(fraction * U64_MAX)
