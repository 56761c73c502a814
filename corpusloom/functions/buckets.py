"""Hash buckets of tokens for bag-of-words vectors."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def blake2b_bucket(token: str, dim: int) -> int:
    """The token's 8-byte BLAKE2b digest, big-endian, modulo dim."""
    return int.from_bytes(hashlib.blake2b(token.encode("utf-8"), digest_size=8).digest(), "big") % dim


def sha2_bucket_of(token: str, dim: int) -> int:
    """sha2_bucket of one token."""
    return int(hashlib.sha256(token.encode("utf-8")).hexdigest()[:8], 16) % dim


def sha2_bucket(token: Column, dim: int) -> Column:
    """The first 32 bits of the token's SHA-256 modulo dim; built-in functions alone."""
    head = F.substring(F.sha2(token.cast("binary"), 256), 1, 8)
    return F.pmod(F.conv(head, 16, 10).cast("long"), F.lit(dim)).cast("int")
