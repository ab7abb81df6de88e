"""Base62, durations and id ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import substr

# The digit alphabet and the unsigned 32-bit range.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
U32_MAX = 4294967295

# 12 bits name the shard, 20 bits count inside it.
SHARD_BITS = 12
COUNTER_BITS = 20


def base62_encode(n: Column) -> Column:
    """Base62 text of a value in ``[0, 2^32)``, most significant digit first."""
    n = n.cast("bigint")
    digits = [
        substr(
            F.lit(BASE62),
            (F.pmod(F.call_function("div", n, F.lit(62**k)), F.lit(62)) + F.lit(1)).cast("int"),
            1,
        )
        for k in range(5, -1, -1)
    ]
    trimmed = F.ltrim(F.concat(*digits), F.lit("0"))
    return F.when(trimmed == "", F.lit("0")).otherwise(trimmed)


def base62_decode(s: Column) -> Column:
    """Value of a base62 text; null when empty, malformed or above 2^32 - 1."""
    stripped = F.ltrim(s, F.lit("0"))
    padded = F.lpad(stripped, 6, "0")
    value = reduce(
        lambda a, b: a + b,
        [
            (F.call_function("instr", F.lit(BASE62), substr(padded, k + 1, 1)) - F.lit(1)).cast(
                "bigint"
            )
            * F.lit(62 ** (5 - k))
            for k in range(6)
        ],
    )
    well_formed = s.rlike("^[0-9A-Za-z]+\\z") & (F.length(stripped) <= 6)
    return F.when(well_formed & (value <= F.lit(U32_MAX)), value)


def parse_duration(s: Column, default_seconds: int) -> Column:
    """Seconds of ``45s``, ``30m``, ``1h``, ``2d`` or a bare number.

    Blanks around the text and before the unit are ignored; anything else
    gives ``default_seconds``. Products saturate at the largest bigint.
    """
    pattern = r"^\s*\+?([0-9]+)\s*([smhd]?)\s*\z"
    number = F.regexp_extract(s, pattern, 1)
    unit = F.regexp_extract(s, pattern, 2)
    factor = (
        F.when(unit == "m", F.lit(60))
        .when(unit == "h", F.lit(3600))
        .when(unit == "d", F.lit(86400))
        .otherwise(F.lit(1))
    )
    top = (1 << 63) - 1
    wide = F.when(number != "", number).try_cast("decimal(20,0)")
    seconds = F.least(wide * factor.cast("decimal(5,0)"), F.lit(top).cast("decimal(26,0)"))
    usable = (number != "") & wide.isNotNull() & (wide <= F.lit("18446744073709551615").cast("decimal(20,0)"))
    return F.when(usable, seconds.cast("bigint")).otherwise(F.lit(default_seconds).cast("bigint"))


def id_space(shard: Column) -> Column:
    """Half-open id range ``struct<base,end>`` owned by a shard number.

    The last shard ends at 2^32 - 1, which keeps the reserved id outside.
    """
    base = F.shiftleft(shard.cast("bigint").bitwiseAND(F.lit((1 << SHARD_BITS) - 1)), COUNTER_BITS)
    end = F.least(base + F.lit(1 << COUNTER_BITS), F.lit(U32_MAX).cast("bigint"))
    return F.struct(base.alias("base"), end.alias("end"))
