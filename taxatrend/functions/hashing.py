"""Digests as column expressions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F

from taxatrend.functions.text import trim_space

BLOCK = 64


def hmac_sha256(message: Column, key: str) -> Column:
    """Hex HMAC-SHA256 of a string under a fixed key (RFC 2104), from two nested digests."""
    raw = key.encode()
    if len(raw) > BLOCK:
        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(BLOCK, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    digest = F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 256)
    return F.sha2(F.concat(outer, F.unhex(digest)), 256)


def pseudonym(identity: Column, salt: str) -> Column:
    """Stable observer pseudonym; null for a blank identity."""
    name = trim_space(identity)
    return F.when(name != "", F.concat(F.lit("obs_"), F.substring(hmac_sha256(F.lower(name), salt), 1, 16)))
