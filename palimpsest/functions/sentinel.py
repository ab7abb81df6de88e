"""The placeholder grammar and its message authentication code.

A placeholder reads ``⟦S[:TYPE]·ID·TAG⟧``: ID and TAG are base62, ID indexes a
vault scope, TAG is a keyed MAC over ID, so only issued placeholders resolve.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .codec import base62_decode, base62_encode
from .expr import let, substr

# Delimiters, the byte bound and the reserved id.
OPEN = "⟦S"
CLOSE = "⟧"
SEP = "·"
TYPE_SEP = ":"
MAX_SENTINEL_BYTES = 64
OVERFLOW_ID = 4294967295

# A type longer than this could push a placeholder beyond MAX_SENTINEL_BYTES:
# delimiters and two six-digit numbers take 24 bytes.
MAX_TYPE_BYTES = MAX_SENTINEL_BYTES - 24

# Everything between an opening and the first closing delimiter whose tail reads
# as two base62 fields. The byte bound is checked on the match.
SENTINEL_PATTERN = "⟦S[^⟧]{0,60}?·[0-9A-Za-z]+·[0-9A-Za-z]+⟧"


def sentinel_head(ty: Column | None) -> Column:
    """What a placeholder begins with; a null or absent type gives the bare style."""
    head = F.lit(OPEN)
    if ty is not None:
        head = F.concat(head, F.coalesce(F.concat(F.lit(TYPE_SEP), ty), F.lit("")))
    return head


def sentinel_rest(id_: Column, tag: Column) -> Column:
    """What follows the head; the same for all types."""
    return F.concat(F.lit(SEP), base62_encode(id_), F.lit(SEP), base62_encode(tag), F.lit(CLOSE))


def sentinel_encode(ty: Column | None, id_: Column, tag: Column) -> Column:
    """Placeholder text; a null or absent type gives the bare style."""
    return F.concat(sentinel_head(ty), sentinel_rest(id_, tag))


def _xor_pad(key_hex: Column, byte: int) -> Column:
    word = int.from_bytes(bytes([byte]) * 4, "big")
    groups = [
        F.lpad(
            F.hex(
                F.conv(substr(key_hex, 8 * i + 1, 8), 16, 10)
                .cast("bigint")
                .bitwiseXOR(F.lit(word).cast("bigint"))
            ),
            8,
            "0",
        )
        for i in range(8)
    ]
    return F.unhex(F.concat(*groups, F.lit(f"{byte:02x}" * 32)))


def mac_pads(key_hex: Column | bytes | str) -> Column:
    """Inner and outer HMAC-SHA256 pads of a 32-byte key as ``struct<i,o>``.

    A Python key (bytes or hex text) is padded here; a column holds hex text.
    """
    if isinstance(key_hex, str):
        key_hex = bytes.fromhex(key_hex)
    if isinstance(key_hex, bytes):
        if len(key_hex) != 32:
            raise ValueError("the key must be 32 bytes")
        block = key_hex + bytes(32)
        return F.struct(
            F.lit(bytes(b ^ 0x36 for b in block)).alias("i"),
            F.lit(bytes(b ^ 0x5C for b in block)).alias("o"),
        )
    return F.struct(_xor_pad(key_hex, 0x36).alias("i"), _xor_pad(key_hex, 0x5C).alias("o"))


def hmac_hex(pads: Column, message: Column) -> Column:
    """HMAC-SHA256 of a binary message as lower-case hex."""
    inner = F.unhex(F.sha2(F.concat(pads["i"], message), 256))
    return F.sha2(F.concat(pads["o"], inner), 256)


def scope_key_hex(secret: bytes | str, scope: Column) -> Column:
    """Tag key of a scope: HMAC-SHA256(secret, scope) as hex.

    Every job that knows the secret derives the same key, so placeholders
    issued by one job authenticate in another.
    """
    return hmac_hex(mac_pads(secret), scope.cast("string").cast("binary"))


def sentinel_tag(pads: Column, id_: Column) -> Column:
    """First four bytes (little endian) of HMAC(key, id as four LE bytes)."""

    def le(h: Column) -> Column:
        return F.concat(*[substr(h, p, 2) for p in (7, 5, 3, 1)])

    message = F.unhex(let(F.lpad(F.hex(id_.cast("bigint")), 8, "0"), le))
    return F.conv(let(substr(hmac_hex(pads, message), 1, 8), le), 16, 10).cast("bigint")


def parse_body(sentinel: Column) -> Column:
    """``struct<id,tag>`` of one complete placeholder text (fields may be null)."""
    inner = substr(sentinel, F.lit(1), F.length(sentinel) - F.lit(1))
    tag = F.substring_index(inner, SEP, -1)
    id_ = F.substring_index(F.substring_index(inner, SEP, -2), SEP, 1)
    return F.struct(base62_decode(id_).alias("id"), base62_decode(tag).alias("tag"))
