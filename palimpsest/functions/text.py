"""Text measures and escapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import let, substr


def shannon_bits(token: Column) -> Column:
    """Shannon entropy of an ASCII token in bits per byte.

    Arithmetic is single precision and runs over the distinct bytes in
    ascending order, so thresholds decide as they do in the byte-wise form.
    """

    def bits(t: Column) -> Column:
        n = F.length(t).cast("float")
        letters = F.array_sort(F.array_distinct(F.filter(F.split(t, ""), lambda c: c != "")))

        def step(h: Column, c: Column) -> Column:
            count = F.length(t) - F.length(F.replace(t, c, F.lit("")))
            p = (count.cast("float") / n).cast("float")
            return (h - (p * F.log2(p).cast("float")).cast("float")).cast("float")

        return F.aggregate(letters, F.lit(0.0).cast("float"), step)

    return let(token, bits)


def json_escape(s: Column) -> Column:
    """JSON string content (no quotes): short escapes, else ``\\u00xx``."""
    out = F.replace(s, F.lit("\\"), F.lit("\\\\"))
    # The two-character escapes.
    for raw, esc in (
        ('"', '\\"'),
        ("\b", "\\b"),
        ("\f", "\\f"),
        ("\n", "\\n"),
        ("\r", "\\r"),
        ("\t", "\\t"),
    ):
        out = F.replace(out, F.lit(raw), F.lit(esc))
    rare = out
    for code in range(0x20):
        if chr(code) not in "\b\f\n\r\t":
            rare = F.replace(rare, F.lit(chr(code)), F.lit(f"\\u{code:04x}"))
    return F.when(out.rlike("[\\x00-\\x1f]"), rare).otherwise(out)


def bounded_capture(body: Column, max_bytes: int) -> Column:
    """``struct<text,truncated>``: the first ``max_bytes`` bytes as text.

    A character cut in half becomes U+FFFD.
    """
    head = F.make_valid_utf8(substr(F.encode(body, "UTF-8"), 1, max_bytes).cast("string"))
    cut = F.octet_length(body) > F.lit(max_bytes)
    return F.struct(
        F.when(cut, head).otherwise(body).alias("text"),
        cut.alias("truncated"),
    )


def request_id(*key: Column) -> Column:
    """Sixteen hex digits, a function of the row key so retries agree."""
    parts = [F.coalesce(k.cast("string"), F.lit("\u0000")) for k in key]
    return substr(F.sha2(F.concat_ws("\u001f", *parts), 256), 1, 16)


# One dotted octet and a strict dotted quad.
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_V4 = rf"{_OCTET}(?:\.{_OCTET}){{3}}"


def _v4_internal(ip: Column) -> Column:
    return ip.rlike(rf"^{_V4}\z") & (
        ip.startswith("127.") | ip.startswith("169.254.") | (ip == "0.0.0.0")
    )


def _v6_words(ip: Column) -> Column:
    """Eight 4-digit hex words of a textual IPv6 address, or null."""
    # A dotted tail becomes two words first.
    quad = F.regexp_extract(ip, rf":({_V4})\z", 1)
    octets = F.split(quad, "\\.")
    word = lambda a, b: F.lower(
        F.concat(
            F.lpad(F.hex(F.get(octets, F.lit(a)).try_cast("int")), 2, "0"),
            F.lpad(F.hex(F.get(octets, F.lit(b)).try_cast("int")), 2, "0"),
        )
    )
    flat = F.when(
        quad != "",
        F.concat(
            substr(ip, F.lit(1), F.length(ip) - F.length(quad)), word(0, 1), F.lit(":"), word(2, 3)
        ),
    ).otherwise(ip)

    def expand(text: Column) -> Column:
        halves = F.split(text, "::")
        words = lambda h: F.filter(F.split(h, ":"), lambda w: w != "")
        head, tail = words(F.get(halves, F.lit(0))), words(F.get(halves, F.lit(1)))
        gap = F.lit(8) - F.size(head) - F.size(tail)
        full = (
            F.when((F.size(halves) == 1) & (F.size(head) == 8), head)
            .when(
                (F.size(halves) == 2) & (gap >= 1),
                F.concat(head, F.array_repeat(F.lit("0"), gap), tail),
            )
        )
        shape = text.rlike(
            "^(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?(?:::)?(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4})*)?\\z"
        )
        return F.when(shape, F.transform(full, lambda w: F.lpad(w, 4, "0")))

    return let(F.lower(flat), expand)


def is_internal_address(ip: Column) -> Column:
    """True for loopback, link-local and unspecified addresses (v4, v6, mapped).

    Ordinary private ranges are not flagged; unparsable text is false.
    """

    def v6(words: Column) -> Column:
        joined = F.array_join(words, "")
        mapped = joined.startswith("0" * 20 + "ffff")
        low = substr(joined, 25, 8)
        mapped_bad = (
            (substr(low, 1, 2) == "7f") | (substr(low, 1, 4) == "a9fe") | (low == "0" * 8)
        )
        plain_bad = (
            (joined == "0" * 31 + "1")
            | (joined == "0" * 32)
            | joined.rlike("^fe[89ab]")
        )
        return F.when(mapped, mapped_bad).otherwise(plain_bad)

    return F.coalesce(
        F.when(F.contains(ip, F.lit(":")), let(_v6_words(ip), v6)).otherwise(_v4_internal(ip)),
        F.lit(False),
    )
