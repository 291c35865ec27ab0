"""Keyed hashes as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a pseudonym begins with, and bytes of a block that SHA-256 works on.
PREFIX, BLOCK = "anon1:", 64


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.col(x)


def hmac_sha256(key: bytes, message) -> Column:
    """The HMAC-SHA256 of a string or binary column in lower-case hex. The padded keys become part of the plan: give the
    session's users no plan that they may not see."""
    if len(key) > BLOCK:
        import hashlib

        key = hashlib.sha256(key).digest()
    inner, outer = (F.lit(bytes(b ^ pad for b in key.ljust(BLOCK, b"\0"))) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, _c(message).cast("binary")), 256))), 256)


def pseudonym(key: bytes, platform, handle) -> Column:
    """The author's pseudonym: `anon1:` and 16 hex digits of the HMAC of platform and handle in lower case. A pseudonym stays
    as it is; a null platform or handle gives null."""
    if len(key) != 32:
        raise ValueError("the key has 32 bytes")
    made = F.concat(F.lit(PREFIX), F.left(hmac_sha256(key, F.concat_ws("|", _c(platform), F.lower(_c(handle)))), F.lit(16)))
    return F.when(_c(handle).startswith(PREFIX), _c(handle)).when(_c(platform).isNotNull() & _c(handle).isNotNull(), made)
