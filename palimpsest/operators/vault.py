"""Interning: one stable id per distinct original inside a scope.

A vault is a table ``(scope_key, id, original, ty, first_seen, uses)``. The key
of an entry is its exact original; the type is only a label.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.codec import COUNTER_BITS, SHARD_BITS, U32_MAX
from ..functions.expr import explode_once
from ..functions.sentinel import OVERFLOW_ID
from .keyed import TARGET_ROWS, has_hot_group, join_safe, number_rows, ranged

VAULT_COLUMNS = ["scope_key", "id", "original", "ty", "first_seen", "uses"]
SHARDS = 1 << SHARD_BITS
SHARD_SIZE = 1 << COUNTER_BITS

# Unit separator between the parts of a scope key.
_US = "\u001f"


def namespace(session: Column, tenant: Column | None = None) -> Column:
    """Scope key of a session. The leading letter is ours, so no session name
    can reach another tenant's scope. Null session: null."""
    general = F.concat(F.lit("g" + _US), session)
    if tenant is None:
        return general
    return F.when(tenant.isNotNull(), F.concat(F.lit("t" + _US), tenant, F.lit(_US), session)).otherwise(
        general
    )


def row_scope(scope: str, key: Sequence[str]) -> Column:
    """The vault a row belongs to; a row without a scope has one of its own, named by its key."""
    own = F.concat(F.lit("r\x1f"), F.to_json(F.struct(*key)))
    return F.coalesce(F.col(scope).cast("string"), own)


def first_seen(
    detected: DataFrame, scope: str, order: Sequence[str], spans: str = "spans"
) -> DataFrame:
    """Distinct originals of each scope with their first position and use count.

    Findings are pre-aggregated before the shuffle. All measures travel in one
    exchange, so later steps that start here share it.
    """
    flat = explode_once(
        detected,
        spans,
        F.col(scope).cast("string").alias("scope_key"),
        *[F.col(c).cast("bigint").alias(f"_o{i}") for i, c in enumerate(order)],
        out="_s",
    )
    place = F.struct(
        *[F.col(f"_o{i}") for i in range(len(order))],
        F.col("_s.byte_start").alias("at"),
        F.col("_s.ty").alias("ty"),
    )
    return flat.groupBy("scope_key", F.col("_s.original").alias("original")).agg(
        F.min(place).alias("place"), F.count(F.lit(1)).alias("uses")
    )


def _flat(first: DataFrame) -> tuple[DataFrame, list[str]]:
    names = [f.name for f in first.schema["place"].dataType.fields]
    order = [n for n in names if n != "ty"]
    return first.select(
        "scope_key", "original", "uses", *[F.col("place")[n].alias(n) for n in names]
    ), order


def intern_session(
    first: DataFrame,
    vault: DataFrame | None = None,
    target: int = TARGET_ROWS,
    hot_groups: bool | None = None,
) -> DataFrame:
    """Entries for originals the vault lacks, ids in order of first sight.

    Ids continue after the largest one of the scope. Returns vault rows; ids
    beyond the id range are reserved and must not be stored (``storable``).
    """
    flat, order = _flat(first)
    base = None
    if vault is not None:
        flat = flat.join(vault.select("scope_key", "original"), ["scope_key", "original"], "left_anti")
        base = (
            vault.where(F.col("id") != OVERFLOW_ID)
            .groupBy("scope_key")
            .agg((F.max("id") + 1).alias("start"))
        )
    numbered = number_rows(flat, ["scope_key"], order, base, "id", target, hot_groups)
    return numbered.select(
        "scope_key",
        F.when(F.col("id") >= U32_MAX, F.lit(OVERFLOW_ID)).otherwise(F.col("id")).alias("id"),
        "original",
        "ty",
        F.col(order[0]).alias("first_seen"),
        "uses",
    )


def shard_of(original: Column, shards: int = SHARDS, how: str = "xxhash64") -> Column:
    """Shard number of an original. ``md5`` can be recomputed elsewhere."""
    if how == "md5":
        value = F.conv(F.substring(F.md5(original.cast("binary")), 1, 8), 16, 10).cast("bigint")
    else:
        value = F.xxhash64(original)
    return F.pmod(value, F.lit(shards)).cast("int")


def intern_sharded(
    first: DataFrame,
    vault: DataFrame | None = None,
    shards: int = SHARDS,
    how: str = "xxhash64",
    shard_size: int = SHARD_SIZE,
) -> DataFrame:
    """Entries with ids from disjoint ranges, one range per shard of originals.

    This is the form for one vault over a whole corpus: equal originals share
    a shard, so shards number their own without coordination. A full shard
    gives the reserved id: masked, never stored, never resolved.
    """
    if not 1 <= shards <= SHARDS or not 1 <= shard_size <= SHARD_SIZE:
        raise ValueError("shards or shard size out of range")
    flat, order = _flat(first)
    flat = flat.withColumn("_shard", shard_of(F.col("original"), shards, how))
    used = F.lit(0)
    if vault is not None:
        flat = flat.join(vault.select("scope_key", "original"), ["scope_key", "original"], "left_anti")
        start = (
            vault.where(F.col("id") != OVERFLOW_ID)
            .groupBy("scope_key", F.shiftright("id", COUNTER_BITS).cast("int").alias("_shard"))
            .agg((F.max(F.col("id").bitwiseAND(F.lit(SHARD_SIZE - 1))) + 1).alias("_start"))
        )
        flat = flat.join(start, ["scope_key", "_shard"], "left")
        used = F.coalesce(F.col("_start"), F.lit(0))
    w = Window.partitionBy("scope_key", "_shard").orderBy("original")
    count = F.row_number().over(w) - 1 + used
    # The very last id of the last shard is the reserved one.
    full = (F.col("_count") >= shard_size) | (F.col("_id") >= U32_MAX)
    return (
        flat.withColumn("_count", count)
        .withColumn("_id", F.shiftleft(F.col("_shard").cast("bigint"), COUNTER_BITS) + F.col("_count"))
        .select(
            "scope_key",
            F.when(full, F.lit(OVERFLOW_ID)).otherwise(F.col("_id")).alias("id"),
            "original",
            "ty",
            F.col(order[0]).alias("first_seen"),
            "uses",
        )
    )


def storable(entries: DataFrame) -> DataFrame:
    """Entries that may enter a vault: those with a real id."""
    return entries.where(F.col("id") != OVERFLOW_ID)


def own_space(vault: DataFrame, base: int, end: int) -> DataFrame:
    """Entries of one id range; a writer commits only its own."""
    return vault.where((F.col("id") >= base) & (F.col("id") < end))


def merge_vault(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per-entry upsert: ``new`` wins on equal ``(scope_key, id)``."""
    both = old.withColumn("_gen", F.lit(0)).unionByName(new.withColumn("_gen", F.lit(1)))
    columns = [c for c in old.columns if c not in ("scope_key", "id")]
    latest = F.max_by(F.struct(*columns), F.col("_gen"))
    return both.groupBy("scope_key", "id").agg(latest.alias("_e")).select(
        "scope_key", "id", *[F.col("_e")[c].alias(c) for c in columns]
    )


def dedup_vault(vault: DataFrame) -> DataFrame:
    """One id per original for masking: the smallest. Older ids still resolve
    through the full vault."""
    return vault.groupBy("scope_key", "original").agg(
        F.min("id").alias("id"), F.min_by("ty", "id").alias("ty"), F.sum("uses").alias("uses")
    )


def sessionize(
    df: DataFrame,
    scope: Sequence[str],
    ts: str,
    ttl_seconds: int,
    out: str = "generation",
    target: int = TARGET_ROWS,
    hot_groups: bool | None = None,
) -> DataFrame:
    """Vault generation of each access: idle for ``ttl`` or more starts a new one.

    Joined to the scope key, it gives expired sessions a fresh vault. A scope
    above ``target`` rows is cut into ranges of time: each is numbered by itself
    and reduced to its first and last access and its breaks; a scan over
    those reductions says what to add. ``hot_groups`` as in ``number_rows``. Rows
    without a time break nothing.
    """
    scope = list(scope)
    seconds = F.col(ts).cast("timestamp").cast("double")
    if hot_groups is None:
        hot_groups = has_hot_group(df, scope, target)
    cut = ranged(df, scope, [ts], target) if hot_groups else df.withColumn("_part", F.lit(0))
    near = [*scope, "_part"]
    order = Window.partitionBy(*near).orderBy(ts)
    running = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    gap = seconds - F.lag(seconds).over(order)
    marked = cut.withColumn("_new", F.when(gap >= ttl_seconds, 1).otherwise(0))
    counted = marked.withColumn("_run", F.sum("_new").over(running))
    if not hot_groups:
        return counted.select(*df.columns, F.col("_run").alias(out))
    reduced = marked.groupBy(*near).agg(
        F.min(seconds).alias("_first"), F.max(seconds).alias("_last"), F.sum("_new").alias("_breaks")
    )
    along = Window.partitionBy(*scope).orderBy("_part")
    up_to = along.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = along.rowsBetween(Window.unboundedPreceding, -1)
    # The last access before a range may lie several ranges back.
    idle = F.col("_first") - F.max("_last").over(before)
    scanned = reduced.withColumn("_cross", F.when(idle >= ttl_seconds, 1).otherwise(0)).select(
        *near, (F.sum("_cross").over(up_to) + F.coalesce(F.sum("_breaks").over(before), F.lit(0))).alias("_shift")
    )
    total = F.col("_run") + F.col("_shift")
    return join_safe(counted, scanned, near).select(*df.columns, total.cast("bigint").alias(out))


def seal(original: Column, passphrase: str) -> Column:
    """AES-256-GCM of a value: nonce, ciphertext and tag in one binary.

    The nonce is random, so write sealed columns once and read them back;
    never join on them.
    """
    key = F.unhex(F.sha2(F.lit(passphrase), 256))
    return F.aes_encrypt(F.encode(original, "UTF-8"), key, F.lit("GCM"))


def unseal(sealed: Column, passphrase: str) -> Column:
    """The sealed text; null if the value was altered or the key differs."""
    key = F.unhex(F.sha2(F.lit(passphrase), 256))
    return F.try_aes_decrypt(sealed, key, F.lit("GCM")).cast("string")
