"""Rehydration: originals in place of authentic placeholders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import let, substr
from ..functions.sentinel import (
    MAX_SENTINEL_BYTES,
    OPEN,
    OVERFLOW_ID,
    SENTINEL_PATTERN,
    mac_pads,
    parse_body,
    scope_key_hex,
    sentinel_tag,
)
from ..functions.text import json_escape
from .keyed import TARGET_ROWS, attach_values
from .vault import row_scope

SEGMENTS = "array<struct<text:string,id:bigint,tag:bigint>>"


def _segment(text: Column, id_: Column, tag: Column) -> Column:
    return F.struct(text.alias("text"), id_.cast("bigint").alias("id"), tag.cast("bigint").alias("tag"))


def _literal(text: Column) -> Column:
    return F.array(_segment(text, F.lit(None), F.lit(None)))


def _openings(text: Column) -> Column:
    """1-based positions of the opening delimiter."""
    return F.filter(
        F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1))),
        lambda i: substr(text, i, F.lit(2)) == OPEN,
    )


def _read(match: Column) -> Column:
    """Segments of one pattern match: a literal prefix, then a placeholder.

    The byte bound counts from the opening delimiter. Junk may have put an
    outer opening too far away; then the first inner one in reach opens.
    """

    def valid(s: Column) -> Column:
        def made(p: Column) -> Column:
            ok = p["id"].isNotNull() & p["tag"].isNotNull()
            return F.array(_segment(s, F.when(ok, p["id"]), F.when(ok, p["tag"])))

        return let(parse_body(s), made)

    def from_inner(starts: Column) -> Column:
        near = F.filter(
            starts, lambda i: F.octet_length(substr(match, i, F.length(match))) <= MAX_SENTINEL_BYTES
        )
        at = F.get(near, F.lit(0))
        return F.when(at.isNull(), _literal(match)).otherwise(
            F.concat(
                _literal(substr(match, F.lit(1), at - 1)),
                valid(substr(match, at, F.length(match))),
            )
        )

    return F.when(F.octet_length(match) <= MAX_SENTINEL_BYTES, valid(match)).otherwise(
        let(_openings(match), from_inner)
    )


def segments(text: Column, tail_mode: str = "strict") -> Column:
    """The text as literal and placeholder segments, in order.

    A placeholder segment has ``id`` and ``tag``; all texts joined give the
    input. In ``strict`` mode a malformed opening with fewer than 64 bytes
    left makes the rest literal, as a reader that waits for more bytes and
    then flushes would have it; ``resolve`` reads on.
    """
    if tail_mode not in ("strict", "resolve"):
        raise ValueError(f"unknown tail mode {tail_mode!r}")

    def build(ctx: Column) -> Column:
        lits, hits = ctx["lits"], ctx["hits"]
        parts = F.flatten(
            F.transform(
                lits,
                lambda s, i: F.when(i < F.size(hits), F.concat(_literal(s), _read(F.get(hits, i)))).otherwise(
                    _literal(s)
                ),
            )
        )
        return let(parts, _strict) if tail_mode == "strict" else parts

    bound = F.struct(
        F.split(text, SENTINEL_PATTERN).alias("lits"),
        F.regexp_extract_all(text, F.lit(SENTINEL_PATTERN), F.lit(0)).alias("hits"),
    )
    return F.when(F.contains(text, F.lit(OPEN)), let(bound, build)).otherwise(_literal(text))


def _strict(parts: Column) -> Column:
    loose = F.exists(parts, lambda s: s["id"].isNull() & F.contains(s["text"], F.lit(OPEN)))

    def hold(first: Column) -> Column:
        return F.transform(
            parts,
            lambda s, i: F.when(
                first.isNotNull() & (i > first), _segment(s["text"], F.lit(None), F.lit(None))
            ).otherwise(s),
        )

    def held_at(s: Column, i: Column) -> Column:
        # Bytes after this segment, then an opening close enough to the end.
        after = F.aggregate(
            F.slice(parts, i + F.lit(2), F.size(parts)),
            F.lit(0),
            lambda n, p: n + F.octet_length(p["text"]),
        )

        def near(tail: Column) -> Column:
            return F.exists(
                _openings(tail),
                lambda p: F.octet_length(substr(tail, p, F.length(tail))) + after
                < MAX_SENTINEL_BYTES,
            )

        suspect = s["id"].isNull() & F.contains(s["text"], F.lit(OPEN))
        tail = F.right(s["text"], F.lit(MAX_SENTINEL_BYTES))
        return F.when(suspect, F.when(let(tail, near), i))

    first = F.array_min(F.transform(parts, held_at))
    return F.when(loose, let(first, hold)).otherwise(parts)


def parse_sentinels(text: Column, tail_mode: str = "resolve") -> Column:
    """``array<struct<text,id,tag>>`` of the well-formed placeholders."""
    return F.filter(segments(text, tail_mode), lambda s: s["id"].isNotNull())


def leak_check(df: DataFrame, column: str) -> DataFrame:
    """Rows that still hold an opening delimiter."""
    return df.where(F.contains(F.col(column), F.lit(OPEN)))


def rehydrate_inline(
    masked: Column, entries: Column, pads: Column, encoding: str = "raw", tail_mode: str = "strict"
) -> Column:
    """Rehydrate from a vault kept in the row (ids are positions). Narrow."""

    def fill(k: Column) -> Column:
        def one(s: Column) -> Column:
            entry = F.when(s["id"] < F.size(entries), F.get(entries, s["id"].cast("int")))
            real = entry.isNotNull() & (sentinel_tag(k, s["id"]) == s["tag"])
            text = json_escape(entry["original"]) if encoding == "json" else entry["original"]
            return F.when(real, text).otherwise(s["text"])

        return F.array_join(F.transform(segments(masked, tail_mode), one), "")

    return F.when(F.contains(masked, F.lit(OPEN)), let(pads, fill)).otherwise(masked)


def rehydrate(
    df: DataFrame,
    vault: DataFrame,
    secret: bytes | str,
    key: Sequence[str],
    scope: str,
    text: str = "masked",
    out: str = "rehydrated",
    encoding: str = "raw",
    tail_mode: str = "strict",
    uses: str | None = None,
    target: int = TARGET_ROWS,
) -> DataFrame:
    """Rehydrate rows by joining a vault table.

    Unknown placeholders find no partner, and the tags of those that do are
    checked after the join, so the cost follows the placeholders and not the
    vault; forged ones stay verbatim. Placeholders travel to the join without
    the text; rows without any are not shuffled. ``encoding="json"`` escapes
    originals for raw JSON text, once per entry. ``uses`` names the vault
    column that counts uses, when some entries are hot.
    """
    right = vault.where(F.col("id") != OVERFLOW_ID)
    if encoding == "json":
        right = right.withColumn("original", json_escape(F.col("original")))
    holds = F.coalesce(F.contains(F.col(text), F.lit(OPEN)), F.lit(False))
    cut = (
        df.where(holds)
        .withColumn("scope_key", row_scope(scope, key))
        .withColumn("_parts", segments(F.col(text), tail_mode))
        .withColumn("_marks", F.filter("_parts", lambda s: s["id"].isNotNull()))
    )
    joined = attach_values(
        cut,
        key,
        "_marks",
        ["scope_key", "id"],
        F.col("text"),
        right,
        "original",
        "_originals",
        carry=["scope_key"],
        uses=uses,
        target=target,
    )

    def fill(pads: Column) -> Column:
        def known(found: Column) -> Column:
            def one(s: Column) -> Column:
                entry = F.when(s["id"].isNotNull(), F.element_at(found, s["text"]))
                return F.when(entry["tag"] == s["tag"], entry["original"]).otherwise(s["text"])

            return F.array_join(F.transform("_parts", one), "")

        # Tags are made once for each placeholder, however often it stands in the text.
        entry = lambda mark, o: F.struct(o.alias("original"), sentinel_tag(pads, parse_body(mark)["id"]).alias("tag"))
        return let(F.transform_values("_originals", entry), known)

    pads = mac_pads(scope_key_hex(secret, F.col("scope_key")))
    filled = F.when(F.col("_originals").isNotNull(), let(pads, fill)).otherwise(F.col(text))
    return joined.select(*df.columns, filled.alias(out)).unionByName(
        df.where(~holds).withColumn(out, F.col(text))
    )


def join_chunks(
    chunks: DataFrame, key: Sequence[str], seq: str = "seq", text: str = "text"
) -> DataFrame:
    """Whole texts of ordered chunks. Rehydrating these does not depend on how
    a response was cut. A response is bounded, so its chunks fit one row."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(seq), F.col(text))))
    return chunks.groupBy(*key).agg(
        F.array_join(F.transform(ordered, lambda c: c[text]), "").alias(text)
    )


def audit_sentinels(
    df: DataFrame,
    vault: DataFrame,
    secret: bytes | str,
    key: Sequence[str],
    scope: str,
    text: str = "masked",
) -> DataFrame:
    """Every placeholder with its verdict: resolved, forged, unknown, overflow
    or malformed. One row per occurrence."""
    loose = F.transform(
        F.filter(segments(F.col(text), "resolve"), lambda s: s["id"].isNull() & F.contains(s["text"], F.lit(OPEN))),
        lambda s: F.size(F.split(s["text"], OPEN)) - 1,
    )
    # Malformed openings become one nameless item each.
    malformed = F.array_repeat(
        _segment(F.lit(OPEN), F.lit(None), F.lit(None)),
        F.aggregate(loose, F.lit(0), lambda a, n: a + n),
    )
    row = F.struct(*[F.col(k) for k in key]).alias("_row")
    items = df.where(F.contains(F.col(text), F.lit(OPEN))).select(
        row,
        F.col(scope).cast("string").alias("scope_key"),
        F.explode(F.concat(parse_sentinels(F.col(text)), malformed)).alias("_m"),
    )
    flat = items.select(
        "_row",
        "scope_key",
        F.col("_m.text").alias("sentinel"),
        F.col("_m.id").alias("id"),
        F.col("_m.tag").alias("tag"),
    )
    right = vault.where(F.col("id") != OVERFLOW_ID).select("scope_key", "id", F.lit(True).alias("_known"))
    # Malformed items have no id: keep them out of the join.
    named = flat.where(F.col("id").isNotNull()).join(right, ["scope_key", "id"], "left")
    pads = mac_pads(scope_key_hex(secret, F.col("scope_key")))
    named = named.withColumn("_tag", F.when(F.col("_known"), sentinel_tag(pads, F.col("id"))))
    verdict = (
        F.when(F.col("id") == OVERFLOW_ID, "overflow")
        .when(F.col("_tag").isNull(), "unknown")
        .when(F.col("_tag") != F.col("tag"), "forged")
        .otherwise("resolved")
    )
    columns = [
        *[F.col("_row")[k].alias(k) for k in key],
        "sentinel",
        F.col("id").alias("sentinel_id"),
        F.col("tag").alias("sentinel_tag"),
    ]
    return named.select(*columns, verdict.alias("verdict")).unionByName(
        flat.where(F.col("id").isNull()).select(*columns, F.lit("malformed").alias("verdict"))
    )


def verify_round_trip(df: DataFrame, original: str, rehydrated: str) -> DataFrame:
    """Rows whose rehydrated text differs from the original."""
    return df.where(~F.col(original).eqNullSafe(F.col(rehydrated)))
