"""Numbering rows and looking up values when a few keys hold most rows.

Groups above a row target are cut into ranges of about that many rows, at
places sampled over the whole order, so no task holds more of them. What ranges
say of themselves (rows, first, last) is a small table that is scanned in
place of the rows. Nothing is dropped or capped.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import explode_once
from ..plans.stage import stage

# Rows one task may number, and uses of one key one task may join.
TARGET_ROWS = 1_000_000
SALTS = 4096


def has_hot_group(df: DataFrame, group: Sequence[str], target: int = TARGET_ROWS) -> bool:
    sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return not sizes.where(F.col("n") > target).isEmpty()


def ranged(df: DataFrame, group: Sequence[str], order: Sequence[str], target: int = TARGET_ROWS, part: str = "_part") -> DataFrame:
    """``df`` with the number of the range each row lies in, by group and order.

    Ranges hold about half the target and follow each other in the order; rows
    equal in group and order are told apart by the other columns. Written
    once, because ranges are sampled anew each time they are planned.
    """
    ranges = max(1, -(-2 * df.count() // target))
    # Maps and variants have no hash.
    plain = [f.name for f in df.schema.fields if not any(k in f.dataType.simpleString() for k in ("map<", "variant"))]
    tie = F.xxhash64(*[c for c in plain if c not in (*group, *order)], F.lit(0))
    dealt = df.withColumn("_tie", tie).repartitionByRange(ranges, *group, *order, "_tie")
    return stage(dealt.withColumn(part, F.spark_partition_id()).drop("_tie"), "ranges")


def join_safe(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Left join in which null keys meet; the columns ``on`` stay once."""
    names = {c: f"_on_{i}" for i, c in enumerate(on)}
    same = None
    for c, n in names.items():
        match = left[c].eqNullSafe(F.col(n))
        same = match if same is None else same & match
    return left.join(right.withColumnsRenamed(names), same, "left").drop(*names.values())


def number_rows(
    df: DataFrame,
    group: Sequence[str],
    order: Sequence[str],
    base: DataFrame | None = None,
    out: str = "position",
    target: int = TARGET_ROWS,
    hot_groups: bool | None = None,
) -> DataFrame:
    """Contiguous 0-based positions inside each group, as ``row_number`` gives.

    A window over a hot group would be one task. Where a group exceeds the
    target, rows are cut into ranges, numbered per range and shifted by the
    rows of the ranges before. ``base`` (group columns and ``start``) gives first
    positions other than zero. ``hot_groups`` states whether a group exceeds
    the target, where the caller knows.
    """
    group = list(group)
    if hot_groups is None:
        hot_groups = has_hot_group(df, group, target)
    if not hot_groups:
        w = Window.partitionBy(*group).orderBy(*order)
        plain = df.withColumn(out, (F.row_number().over(w) - 1).cast("bigint"))
        if base is None:
            return plain
        shifted = F.col(out) + F.coalesce("start", F.lit(0))
        return join_safe(plain, base.select(*group, "start"), group).select(*df.columns, shifted.cast("bigint").alias(out))
    cut = ranged(df, group, order, target)
    counts = cut.groupBy(*group, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.withColumn("_shift", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    if base is not None:
        shifts = join_safe(shifts, base.select(*group, "start"), group)
        shifts = shifts.withColumn("_shift", F.col("_shift") + F.coalesce("start", F.lit(0))).drop("start")
    inside = Window.partitionBy(*group, "_part").orderBy(*order)
    numbered = cut.withColumn("_row", F.row_number().over(inside) - 1)
    position = F.col("_row") + F.col("_shift")
    return join_safe(numbered, shifts, [*group, "_part"]).select(*df.columns, position.cast("bigint").alias(out))


def lookup(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    value: str,
    uses: str | None = None,
    target: int = TARGET_ROWS,
) -> DataFrame:
    """Left equi-join fetching ``value``; ``right`` has one row per key.

    ``uses`` names a column of ``right`` that counts the rows of ``left`` per
    key. Keys above the target are served from a broadcast of just those
    keys, and their rows are salted so that the shuffle stays even.
    """
    on = list(on)
    if uses is None:
        return left.join(right.select(*on, value), on, "left")
    hot = right.where(F.col(uses) > target).select(
        *on, F.col(value).alias("_hot_value"), F.lit(True).alias("_hot")
    )
    marked = left.join(F.broadcast(hot), on, "left").withColumn(
        "_salt",
        F.when(
            F.col("_hot"), F.lit(1) + F.pmod(F.xxhash64(*left.columns), F.lit(SALTS)).cast("int")
        ).otherwise(F.lit(0)),
    )
    cold = right.select(*on, F.col(value).alias("_cold_value"), F.lit(0).alias("_salt"))
    return marked.join(cold, [*on, "_salt"], "left").select(
        *left.columns, F.coalesce("_hot_value", "_cold_value").alias(value)
    )


def attach_values(
    df: DataFrame,
    key: Sequence[str],
    items: str,
    on: Sequence[str],
    label: Column,
    right: DataFrame,
    value: str,
    out: str,
    carry: Sequence[str] = (),
    uses: str | None = None,
    target: int = TARGET_ROWS,
) -> DataFrame:
    """Attach ``map<label, value>`` of each row's items, fetched from a table.

    ``key`` identifies a row; ``items`` is an array of structs; ``carry``
    names row columns that belong to the lookup key. Only the distinct items
    travel to the lookup, never the text. Pass rows that have items.
    """
    # Row keys are renamed meanwhile: they may be called like lookup columns.
    rows = [F.col(k).alias(f"_k{i}") for i, k in enumerate(key)]
    names = [f"_k{i}" for i in range(len(rows))]
    flat = explode_once(df.withColumn("_d", F.array_distinct(items)), "_d", *rows, *carry, out="_i")
    flat = flat.select(*flat.columns[:-1], "_i.*").withColumn("_label", label)
    wanted = list(dict.fromkeys([*names, *on, "_label"]))
    found = lookup(flat.select(*wanted), right, on, value, uses, target)
    per_row = (
        found.where(F.col(value).isNotNull())
        .groupBy(*names)
        .agg(F.collect_set(F.struct(F.col("_label"), F.col(value))).alias("_pairs"))
        .select(
            *[F.col(n).alias(k) for n, k in zip(names, key)],
            F.map_from_entries("_pairs").alias(out),
        )
    )
    return df.join(per_row, list(key), "left")
