"""Masking: placeholders in place of findings."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import byte_slice, let, where_filled
from ..functions.sentinel import OVERFLOW_ID, mac_pads, scope_key_hex, sentinel_head, sentinel_rest, sentinel_tag
from .detect import detect
from .keyed import TARGET_ROWS, attach_values
from .report import report_of
from .ruleset import Ruleset
from .vault import first_seen, intern_session, intern_sharded, row_scope, storable

STYLES = ("typed-sentinel", "bare-sentinel")


def apply_spans(
    text: Column,
    spans: Column,
    id_of: Callable[[Column], Column],
    pads: Column,
    style: str | Column = "typed-sentinel",
    known: Column | None = None,
) -> Column:
    """Splice placeholders over resolved spans.

    ``known`` maps originals to the ids that ``id_of`` gives; what follows from
    an id is then made once for each original, not for each span.

    ``spans`` should be a plain column. Slices are cut from the UTF-8 bytes,
    so the cost is linear in the text.
    """
    if isinstance(style, str):
        if style not in STYLES:
            raise ValueError(f"unknown style {style!r}")
        typed = F.lit(style == "typed-sentinel")
    else:
        typed = style == "typed-sentinel"

    def splice(ctx: Column) -> Column:
        binary, keys, rests = ctx["b"], ctx["k"], ctx["r"]

        def piece(s: Column, i: Column) -> Column:
            before = F.coalesce(F.get(spans, i - F.lit(1))["byte_end"], F.lit(0))
            rest = let(id_of(s), lambda n: sentinel_rest(n, sentinel_tag(keys, n)))
            if known is not None:
                rest = F.coalesce(F.element_at(rests, s["original"]), rest)
            mark = F.concat(sentinel_head(F.when(typed, s["ty"])), rest)
            # A missing placeholder would take the text before it along.
            mark = F.coalesce(mark, F.raise_error(F.lit("a finding has no placeholder")).cast("string"))
            return F.concat(byte_slice(binary, before, s["byte_start"]), mark)

        last = F.element_at(spans, -1)["byte_end"]
        tail = byte_slice(binary, last, F.octet_length(binary))
        return F.array_join(F.concat(F.transform(spans, piece), F.array(tail)), "")

    def bind(keys: Column) -> Column:
        rests = F.lit(None)
        if known is not None:
            rests = F.transform_values(known, lambda _, n: sentinel_rest(n, sentinel_tag(keys, n)))
        return let(F.struct(F.encode(text, "UTF-8").alias("b"), keys.alias("k"), rests.alias("r")), splice)

    return F.when(F.size(spans) > 0, let(pads, bind)).otherwise(text)


def intern_row(originals: Column) -> Column:
    """``struct<ids, entries>`` of one row's originals.

    ``ids`` goes with ``originals`` one by one, numbered by first sight;
    ``entries`` is the row's vault. Equal originals meet by sorting, so a row
    with very many findings is no search for each of them.
    """

    def number(ordered: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(ordered) - 1)
        heads = F.filter(
            places,
            lambda p: (p == 0) | (F.get(ordered, p)["o"] != F.get(ordered, p - 1)["o"]),
        )

        def by_head(first: Column) -> Column:
            # Heads in order of sight, then the rank of each head.
            seen = F.array_sort(
                F.transform(first, lambda p, j: F.struct(F.get(ordered, p)["i"].alias("i"), j.alias("j")))
            )
            ranks = lambda r: F.array_sort(
                F.transform(r, lambda x, k: F.struct(x["j"].alias("j"), k.alias("id")))
            )

            def spread(rank: Column) -> Column:
                def group(p: Column, j: Column) -> Column:
                    end = F.coalesce(F.get(first, j + 1), F.size(ordered))
                    return F.transform(
                        F.sequence(p, end - 1),
                        lambda q: F.struct(
                            F.get(ordered, q)["i"].alias("i"),
                            F.get(rank, j)["id"].cast("bigint").alias("id"),
                        ),
                    )

                spans = F.array_sort(F.flatten(F.transform(first, group)))
                return F.transform(spans, lambda x: x["id"])

            def finish(order: Column) -> Column:
                entries = F.transform(
                    order,
                    lambda x, k: F.struct(
                        k.cast("bigint").alias("id"),
                        F.get(ordered, F.get(first, x["j"]))["o"].alias("original"),
                    ),
                )
                return F.struct(let(ranks(order), spread).alias("ids"), entries.alias("entries"))

            return let(seen, finish)

        return let(heads, by_head)

    pairs = F.array_sort(F.transform(originals, lambda o, i: F.struct(o.alias("o"), i.alias("i"))))
    empty = F.struct(
        F.array().cast("array<bigint>").alias("ids"),
        F.array().cast("array<struct<id:bigint,original:string>>").alias("entries"),
    )
    return F.when(F.size(originals) > 0, let(pairs, number)).otherwise(empty)


def mask_request(
    df: DataFrame,
    ruleset: Ruleset,
    secret: bytes | str,
    scope: str,
    text: str = "text",
    style: str = "typed-sentinel",
    tenant: str | None = None,
    custom: Sequence = (),
    glossary: DataFrame | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """Mask each row with a vault of its own. One projection, no shuffle.

    ``glossary`` and ``key`` as in ``detect``.

    Adds ``masked``, ``entries`` (the row's vault) and ``report``. The tag key
    derives from ``secret`` and the row's ``scope`` value, so a placeholder of
    one row means nothing in another. Rows without a scope share one tag key.
    """
    found = detect(df, ruleset, text, tenant, custom, glossary=glossary, key=key)
    kept = found.withColumn(
        "_row", intern_row(F.transform("spans", lambda s: s["original"]))
    ).withColumn("_numbered", F.zip_with("spans", "_row.ids", lambda s, i: s.withField("id", i)))
    named = F.coalesce(F.col(scope).cast("string"), F.lit("r\x1f"))
    pads = mac_pads(scope_key_hex(secret, named))
    return kept.select(
        *df.columns,
        apply_spans(F.col(text), F.col("_numbered"), lambda s: s["id"], pads, style).alias("masked"),
        F.col("_row.entries").alias("entries"),
        report_of(F.col("spans")).alias("report"),
    )


def mask_with_vault(
    detected: DataFrame,
    entries: DataFrame,
    secret: bytes | str,
    key: Sequence[str],
    scope: str,
    text: str = "text",
    style: str = "typed-sentinel",
    spans: str = "spans",
    uses: str | None = None,
    target: int = TARGET_ROWS,
    render: Callable[[Callable[[Column], Column], Column], Column] | None = None,
) -> DataFrame:
    """Mask rows that have findings with ids of a vault table.

    Originals the vault lacks get the reserved id. ``uses`` names the column
    of ``entries`` that counts the rows per original, for skewed originals.
    ``render`` makes the masked value from the id of a span and the tag pads,
    where that is more than ``text`` with ``spans`` replaced.
    """
    kept = ["scope_key", "original", "id"] + ([uses] if uses else [])
    ready = detected.withColumn("scope_key", row_scope(scope, key))
    originals = F.transform(spans, lambda s: F.struct(s["original"].alias("original")))
    joined = attach_values(
        ready.withColumn("_originals", originals),
        key,
        "_originals",
        ["scope_key", "original"],
        F.col("original"),
        entries.select(*kept),
        "id",
        "_ids",
        carry=["scope_key"],
        uses=uses,
        target=target,
    )
    pads = mac_pads(scope_key_hex(secret, F.col("scope_key")))

    def id_of(s: Column) -> Column:
        return F.coalesce(F.element_at("_ids", s["original"]), F.lit(OVERFLOW_ID))

    whole = apply_spans(F.col(text), F.col(spans), id_of, pads, style, F.col("_ids")) if render is None else render(id_of, pads)
    return joined.select(
        *[c for c in detected.columns if c != spans],
        whole.alias("masked"),
        report_of(F.col(spans)).alias("report"),
    )


def mask_session(
    detected: DataFrame,
    secret: bytes | str,
    key: Sequence[str],
    scope: str,
    order: Sequence[str],
    vault: DataFrame | None = None,
    text: str = "text",
    style: str = "typed-sentinel",
    sharded: bool = False,
    shards: int = 4096,
    shard_hash: str = "xxhash64",
    target: int = TARGET_ROWS,
    stage: Callable[..., DataFrame] | None = None,
    render: Callable[[Callable[[Column], Column], Column], Column] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Mask rows that share a vault per scope: ``(masked rows, new entries)``.

    ``order`` ranks rows inside a scope (for example the turn). ``sharded``
    numbers originals per shard instead of by first sight. Rows without
    findings are never shuffled. A row whose scope is null has a vault of its
    own, named by its key; ``rehydrate`` with the same key finds it.

    ``render`` as in ``mask_with_vault``.

    Interning reads the findings several times. ``stage`` (see
    ``plans.stage``) writes the detected rows, parted by whether they have
    findings, and the distinct originals once; it then also shows whether any scope or original is hot. Write the
    new entries before the masked rows leave the job.
    """
    # The name may not meet one of the table's own columns.
    scoped = detected.withColumn("_scope_of_row", row_scope(scope, key))
    if stage is not None:
        # Texts are scanned once: either side reads its own folder.
        filled = F.coalesce(F.size("spans") > 0, F.lit(False))
        both = stage(scoped.withColumn("_filled", filled), "detected", ["_filled"])
        hits = both.where("_filled").drop("_filled")
        rest = both.where(~F.col("_filled"))
    else:
        hits, rest = where_filled(scoped, "spans"), detected.where(F.size("spans") == 0)
    first = first_seen(hits, "_scope_of_row", order)
    hot_groups, uses = None, "uses"
    if stage is not None:
        first = stage(first, "originals")
        sizes = first.groupBy("scope_key").agg(
            F.count(F.lit(1)).alias("n"), F.max("uses").alias("uses")
        )
        top = sizes.agg(F.max("n").alias("n"), F.max("uses").alias("uses")).first()
        hot_groups = (top["n"] or 0) > target
        uses = "uses" if (top["uses"] or 0) > target else None
    if sharded:
        new = intern_sharded(first, vault, shards, shard_hash)
    else:
        new = intern_session(first, vault, target, hot_groups)
    known = storable(new).select("scope_key", "original", "id", "uses")
    if vault is not None:
        seen = vault.groupBy("scope_key", "original").agg(F.min("id").alias("id"))
        counted = first.select("scope_key", "original", "uses")
        known = known.unionByName(
            seen.join(counted, ["scope_key", "original"], "inner").select(*known.columns)
        )
    if stage is not None:
        new = stage(new, "entries")
        if vault is None:
            known = storable(new).select("scope_key", "original", "id", "uses")
    masked = mask_with_vault(
        hits, known, secret, key, "_scope_of_row", text, style, uses=uses, target=target, render=render
    ).drop("_scope_of_row")
    untouched = rest.select(
        *[c for c in detected.columns if c != "spans"],
        F.col(text).alias("masked"),
        _empty_report().alias("report"),
    )
    return masked.unionByName(untouched), storable(new)


def _empty_report() -> Column:
    return F.struct(
        F.create_map().cast("map<string,bigint>").alias("by_type"),
        F.lit(0).cast("bigint").alias("total"),
        F.lit("").alias("summary"),
    )


def dry_run(
    df: DataFrame,
    ruleset: Ruleset,
    text: str = "text",
    glossary: DataFrame | None = None,
    key: Sequence[str] = (),
) -> DataFrame:
    """The report only: the text stays as it is and no vault is written."""
    found = detect(df, ruleset, text, glossary=glossary, key=key)
    return found.select(*df.columns, report_of(F.col("spans")).alias("report"))
