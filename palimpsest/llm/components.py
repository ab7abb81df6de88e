"""Connected components, and filters of wanted ids.

Components come by rounds of random contraction.

Each round every vertex joins the neighbour that a hash of the round ranks
lowest, if lower than itself; edges move to the vertices that stay. Ranks
change by round, so long paths shrink by a share, not by one step. Vertices,
labels and edges stay tables in the shared folder throughout.
"""

from __future__ import annotations

import numpy as np
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``(v, component)`` for every vertex of ``edges``; component: its least vertex.

    Loops, repeated and reversed edges and null ends are allowed; null ends
    link with nothing. No edges give no rows.
    """
    pairs = edges.where(F.col(a) != F.col(b)).select(
        F.least(a, b).alias("a"), F.greatest(a, b).alias("b")
    )
    pairs = stage(pairs.distinct(), "edges")
    vertices = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    labels = vertices.select("v", F.col("v").alias("root"))
    number = 0
    while not pairs.isEmpty():
        number += 1

        def rank(c: str, number: int = number):
            return F.struct(F.xxhash64(F.col(c), F.lit(number)).alias("h"), F.col(c).alias("to"))

        both = pairs.select(F.inline(F.array(
            F.struct(F.col("a").alias("v"), F.col("b").alias("w")),
            F.struct(F.col("b").alias("v"), F.col("a").alias("w")),
        )))
        step = both.groupBy("v").agg(F.min(rank("w")).alias("m"))
        step = stage(step.select("v", F.least("m", rank("v"))["to"].alias("to")), "step")
        moved = labels.join(step.withColumnRenamed("v", "root"), "root", "left")
        labels = stage(moved.select("v", F.coalesce("to", "root").alias("root")), "labels")
        for end in ("a", "b"):
            hop = step.select(F.col("v").alias(end), F.col("to").alias(f"_{end}"))
            pairs = pairs.join(hop, end)
        pairs = pairs.where(F.col("_a") != F.col("_b")).select(
            F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")
        )
        pairs = stage(pairs.distinct(), "edges")
    least = labels.groupBy("root").agg(F.min("v").alias("component"))
    return labels.join(least, "root").select("v", "component")


# Bits of an id filter: 2 ** 26, eight megabytes, whatever the number of ids.
FILTER_BITS = 26


def filter_slot(key: str) -> Column:
    """The bit of an id in an id filter."""
    return F.pmod(F.xxhash64(F.col(key).cast("long")), F.lit(1 << FILTER_BITS))


def id_filter(ids: DataFrame, key: str, slot: Column | None = None) -> Broadcast:
    """A one-hash Bloom filter of the longs in ``ids[key]``, of fixed size.

    Tasks ask ``slots_in(filter.value, slots)`` with ``filter_slot`` of their
    rows, or with ``slot`` (0 to ``2 ** FILTER_BITS`` - 1) where that is given. It may let others through, so an exact join has to follow; it never
    loses an id, and spares the shuffle of rows whose id is not wanted.
    """
    # Spark numbers buckets and bits from 1 on.
    rows = ids.where(F.col(key).isNotNull()).select(((filter_slot(key) if slot is None else slot) + 1).alias("slot"))
    maps = rows.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    packed = np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    # At most 2 ** FILTER_BITS / 32768 buckets of 4 KB.
    found = maps.toArrow()
    for bucket, bits in zip(found["bucket"].to_pylist(), found["bits"].to_pylist()):
        packed[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(bits, np.uint8)
    return ids.sparkSession.sparkContext.broadcast(packed)


def slots_in(packed: np.ndarray, slots: np.ndarray) -> np.ndarray:
    return (packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1 == 1
