"""The hash-chained audit log and the transaction table.

A record's hash covers the previous hash, so an edit, a deletion or a reorder
shows. Writing a chain is sequential by its nature; verifying it is not.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import running
from ..functions.text import bounded_capture, request_id
from .glossary import detect_literals_large
from .keyed import TARGET_ROWS, number_rows

# Field order is part of the format.
FIELDS = ["seq", "ts", "route", "tenant", "mode", "detected", "types"]
RECORD_SCHEMA = (
    "seq bigint, ts bigint, route string, tenant string, mode string, detected bigint, "
    "types map<string,bigint>, prev string, hash string"
)
# Records per chain file. A longer history continues in the next segment.
SEGMENT_ROWS = 10_000
CAPTURE_BYTES = 65536


def sorted_types(types: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(types)))


def _head(fields: dict[str, Column]) -> Column:
    """JSON of a record up to the value of ``prev``."""
    body = F.to_json(
        F.struct(*[fields[f].alias(f) for f in FIELDS]), {"ignoreNullFields": "false"}
    )
    return F.concat(F.substr(body, F.lit(1), F.length(body) - 1), F.lit(',"prev":"'))


def chain_hash(prev: Column, head: Column) -> Column:
    return F.sha2(F.concat(prev, head, prev, F.lit('","hash":""}')), 256)


def chain_append(
    records: DataFrame,
    chain: Sequence[str],
    order: Sequence[str],
    start: DataFrame | None = None,
    segment_rows: int = SEGMENT_ROWS,
    target: int = TARGET_ROWS,
) -> DataFrame:
    """Number and link records: adds ``segment``, ``seq``, ``prev``, ``hash``.

    Each (chain, segment) is a chain of its own that starts at sequence 0, so
    no task holds more than ``segment_rows`` records of a busy chain.
    ``chain_seals`` links the segments.
    ``order`` must be total inside a chain; its first column is an integer. ``start`` (chain columns,
    ``segment``, ``seq``, ``prev``) continues segments that exist: the first
    new record gets that ``seq`` and links to that ``prev``.
    """
    chain = list(chain)
    base = None
    if start is not None:
        base = start.select(
            *chain, (F.col("segment") * segment_rows + F.col("seq")).alias("start")
        )
    placed = number_rows(records, chain, order, base, "_pos", target)
    cut = placed.withColumn("segment", F.call_function("div", F.col("_pos"), F.lit(segment_rows)))
    cut = cut.withColumn("seq", F.pmod("_pos", F.lit(segment_rows)).cast("bigint"))
    fields = {f: F.col(f) for f in FIELDS}
    fields["types"] = sorted_types(F.col("types"))
    keep = [c for c in records.columns if c not in chain]
    record = F.struct("seq", _head(fields).alias("head"), F.struct(*keep).alias("record"))
    ordered = F.array_sort(
        F.collect_list(record), lambda a, b: F.signum(a["seq"] - b["seq"]).cast("int")
    )
    # Else the segments of a chain would stay in the task that numbered it.
    groups = cut.repartition(*chain, "segment").groupBy(*chain, "segment").agg(ordered.alias("_list"))
    first = F.lit("")
    if start is not None:
        heads = start.select(*chain, "segment", F.col("prev").alias("_start_prev"))
        groups = groups.join(heads, [*chain, "segment"], "left")
        first = F.coalesce("_start_prev", F.lit(""))
    hashes = running(F.col("_list"), first, lambda prev, r: chain_hash(prev, r["head"]))
    paired = F.zip_with(
        "_list",
        hashes,
        lambda r, h: F.struct(
            r["record"].alias("record"), r["seq"].alias("seq"), h["before"].alias("prev"), h["after"].alias("hash")
        ),
    )
    return groups.select(*chain, "segment", F.explode(paired).alias("_r")).select(
        *chain, "segment", "_r.seq", *[F.col(f"_r.record.{c}").alias(c) for c in keep], "_r.prev", "_r.hash"
    )


def check_records(df: DataFrame) -> DataFrame:
    """Add ``hash_ok``: the record's own hash holds. One projection."""
    fields = {f: F.col(f) for f in FIELDS}
    fields["types"] = sorted_types(F.col("types"))
    ok = chain_hash(F.col("prev"), _head(fields)) == F.col("hash")
    return df.withColumn("hash_ok", F.coalesce(ok, F.lit(False)))


def _linked(df: DataFrame, chain: Sequence[str], position: str | None) -> DataFrame:
    """Each record next to its predecessor; one equi-join, no ordered window.

    An outer join, so the place after the last record of a run shows too.
    """
    chain = list(chain)
    place = F.col(position) if position else F.col("seq")
    label = F.col("seq")
    if position:
        label = F.coalesce(label, F.col("line_no") if "line_no" in df.columns else place)
    own = check_records(df).select(
        *chain,
        place.cast("bigint").alias("_pos"),
        F.col("seq").alias("_seq"),
        label.cast("bigint").alias("_label"),
        F.col("prev").alias("_prev"),
        F.col("hash").alias("_hash"),
        (F.col("hash_ok") & (F.col("seq") == place)).alias("_ok"),
    )
    after = own.select(*chain, (F.col("_pos") + 1).alias("_pos"), F.col("_hash").alias("_prior"))
    origin = df.select(*chain).distinct().select(
        *chain, F.lit(0).cast("bigint").alias("_pos"), F.lit("").alias("_prior")
    )
    met = own.withColumn("_here", F.lit(True)).join(
        after.unionByName(origin).withColumn("_expected", F.lit(True)), [*chain, "_pos"], "full"
    )
    good = F.col("_here") & F.col("_ok") & F.col("_expected") & (F.col("_prev") == F.col("_prior"))
    return met.withColumn("_good", F.coalesce(good, F.lit(False)))


def chain_verify(
    df: DataFrame, chain: Sequence[str], position: str | None = None
) -> DataFrame:
    """Per chain: ``count`` of records before the first break, ``last_hash`` of
    the last good one, and ``broken_at`` (null if intact).

    ``position`` names a column with the record's place in its file; without
    it the sequence number is the place. A cut tail cannot be seen.
    """
    stops = _linked(df, chain, position).where(~F.col("_good"))
    return stops.groupBy(*chain).agg(
        F.min("_pos").alias("count"),
        F.coalesce(F.min_by("_prior", "_pos"), F.lit("")).alias("last_hash"),
        F.min_by("_label", F.when(F.col("_here"), F.col("_pos"))).alias("broken_at"),
    )


def tamper_localise(
    df: DataFrame, chain: Sequence[str], position: str | None = None
) -> DataFrame:
    """Every record that is bad by itself or does not link: ``(…, at, problem)``."""
    bad = _linked(df, chain, position).where(F.col("_here") & ~F.col("_good"))
    problem = (
        F.when(~F.coalesce("_ok", F.lit(False)), "record altered")
        .when(F.col("_expected").isNull(), "predecessor missing")
        .otherwise("predecessor differs")
    )
    return bad.select(*chain, F.col("_label").alias("at"), problem.alias("problem"))


def _seal(prev: Column, segment: Column, count: Column, last_hash: Column) -> Column:
    return F.sha2(F.concat_ws("|", prev, segment, count, last_hash), 256)


def chain_seals(
    records: DataFrame, chain: Sequence[str], start: DataFrame | None = None
) -> DataFrame:
    """One seal for each segment: ``(chain, segment, count, last_hash, prev_seal, seal)``.

    A seal covers its segment's length, its last hash and the seal before, so
    segments, hashed apart, make one history. ``start`` (chain columns,
    ``seal``) holds the last seal before these records. One row of a chain
    folds its seals, a ``segment_rows``-th of its records.
    """
    chain = list(chain)
    sizes = records.groupBy(*chain, "segment").agg(
        F.count(F.lit(1)).alias("count"), F.max_by("hash", "seq").alias("last_hash")
    )
    listed = sizes.groupBy(*chain).agg(
        F.sort_array(F.collect_list(F.struct("segment", "count", "last_hash"))).alias("_list")
    )
    first = F.lit("")
    if start is not None:
        listed = listed.join(start.select(*chain, F.col("seal").alias("_before")), chain, "left")
        first = F.coalesce("_before", F.lit(""))
    seals = running(
        F.col("_list"), first, lambda prev, x: _seal(prev, x["segment"], x["count"], x["last_hash"])
    )
    paired = F.zip_with(
        "_list",
        seals,
        lambda x, h: F.struct(
            x["segment"], x["count"], x["last_hash"], h["before"].alias("prev_seal"), h["after"].alias("seal")
        ),
    )
    return listed.select(*chain, F.explode(paired).alias("_s")).select(
        *chain, *[F.col(f"_s.{c}").alias(c) for c in ("segment", "count", "last_hash", "prev_seal", "seal")]
    )


def verify_history(
    records: DataFrame, seals: DataFrame, chain: Sequence[str], heads: DataFrame | None = None
) -> DataFrame:
    """Per chain, whole histories: ``(chain, count, broken_segment, problem)``.

    ``count`` records from the start are good, whatever the segments' length;
    ``broken_segment`` and ``problem`` are null if all are. An edit, a cut
    record, the cut tail of a segment and a missing segment all show. Losing
    the last segments with their seals shows only against ``heads`` (chain
    columns, ``seal``), the last seals, kept elsewhere.
    """
    chain = list(chain)
    place = [*chain, "segment"]
    found = chain_verify(records, place).select(
        *place, F.col("count").alias("_n"), F.col("last_hash").alias("_last"), "broken_at", F.lit(True).alias("_here")
    )
    before = seals.select(*chain, (F.col("segment") + 1).alias("segment"), F.col("seal").alias("_before"))
    sealed = seals.join(before, place, "left").withColumn("_sealed", F.lit(True))
    linked = F.col("prev_seal") == F.coalesce("_before", F.when(F.col("segment") == 0, ""))
    own = _seal(F.col("prev_seal"), F.col("segment"), F.col("count"), F.col("last_hash")) == F.col("seal")
    no = F.lit(False)
    problem = (
        F.when(F.col("_sealed").isNull(), "segment not sealed")
        .when(~F.coalesce(own, no), "seal altered")
        .when(~F.coalesce(linked, no), "seal before missing or altered")
        .when(F.col("_here").isNull(), "segment missing")
        .when(F.col("broken_at").isNotNull(), "record altered or missing")
        .when(F.col("_n") < F.col("count"), "tail missing")
        .when(F.col("_n") > F.col("count"), "records added")
        .when(~F.coalesce(F.col("_last") == F.col("last_hash"), no), "segment replaced")
    )
    met = sealed.join(found, place, "full").withColumn("problem", problem)
    known = F.col("problem").isNull() | F.col("problem").isin("record altered or missing", "tail missing")
    kept = F.when(known, F.coalesce("_n", F.lit(0))).when(F.col("problem") == "records added", F.col("count")).otherwise(0)
    rows = met.select(*place, kept.cast("bigint").alias("n"), "problem", "seal")
    if heads is not None:
        last = heads.select(*chain, F.col("seal").alias("_head"))
        ends = rows.groupBy(*chain).agg(F.max("segment").alias("segment"), F.max_by("seal", "segment").alias("seal"))
        cut = last.join(ends, chain, "left").where(~F.coalesce(F.col("seal") == F.col("_head"), no))
        rows = rows.unionByName(
            cut.select(
                *chain,
                (F.coalesce("segment", F.lit(-1)) + 1).alias("segment"),
                F.lit(0).cast("bigint").alias("n"),
                F.lit("last segments missing").alias("problem"),
                "seal",
            )
        )
    listed = rows.groupBy(*chain).agg(F.sort_array(F.collect_list(F.struct("segment", "n", "problem"))).alias("_list"))
    bad = F.get(F.filter("_list", lambda s: s["problem"].isNotNull()), F.lit(0))

    def total(b: Column) -> Column:
        upto = F.filter("_list", lambda s: b["segment"].isNull() | (s["segment"] <= b["segment"]))
        return F.aggregate(upto, F.lit(0).cast("bigint"), lambda t, s: t + s["n"])

    return listed.withColumn("_bad", bad).select(
        *chain,
        total(F.col("_bad")).alias("count"),
        F.col("_bad.segment").alias("broken_segment"),
        F.col("_bad.problem").alias("problem"),
    )


def transactions(
    df: DataFrame, key: Sequence[str], max_body_bytes: int = CAPTURE_BYTES
) -> DataFrame:
    """The exchange as a service saw it: masked bodies, bounded.

    Needs ``ts, route, tenant, method, path, status, mode, report, request,
    response``; the bodies are the masked ones.
    """
    return df.select(
        request_id(*[F.col(k) for k in key]).alias("id"),
        "ts",
        "route",
        "tenant",
        "method",
        "path",
        "status",
        "mode",
        F.col("report.total").alias("detected"),
        F.col("report.by_type").alias("types"),
        bounded_capture(F.col("request"), max_body_bytes).alias("_q"),
        bounded_capture(F.col("response"), max_body_bytes).alias("_a"),
    ).select(
        "id", "ts", "route", "tenant", "method", "path", "status", "mode", "detected", "types",
        F.col("_q.text").alias("request"),
        F.col("_q.truncated").alias("request_truncated"),
        F.col("_a.text").alias("response"),
        F.col("_a.truncated").alias("response_truncated"),
    )


def secret_free_check(
    logged: DataFrame,
    vault: DataFrame,
    key: Sequence[str],
    body: str,
    scope: str,
    limit: int | None = None,
) -> DataFrame:
    """Logged rows whose body holds an original of their scope.

    The vault is searched as a glossary, scope by scope.
    """
    terms = vault.select(
        F.col("id").alias("term_ord"),
        F.col("original").alias("term"),
        F.lit("LEAK").alias("ty"),
        F.lit(0).alias("priority"),
        F.col("scope_key").alias("tenant"),
    )
    options = {} if limit is None else {"limit": limit}
    found = detect_literals_large(logged, terms, key, body, scope, "_leaks", **options)
    return found.where(F.size("_leaks") > 0).select(
        *key, F.size("_leaks").cast("bigint").alias("leaks")
    )
