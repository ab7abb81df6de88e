"""Similarity join on word n-grams: rare-first prefixes, filters, one verification.

Sets of distinct n-grams link when ``100 * intersection >= percent * union``.
The n-grams of a set are put in one global order, rare ones first, and only the
first ``n - ceil(percent * n / 100) + 1`` of them, the prefix, are indexed: sets
that link share one of those. Lengths, positions in the prefix and a histogram
of the whole set (the suffix filter with fixed pivots) rule pairs out; what is
left is verified once per pair on the whole sets.

Order. Frequencies are counted over all rows in ``2 ** SLOT_BITS`` hash slots, a
table of fixed size that every task can hold. Any fixed order gives right
results; the counts only make prefixes rare.

Groups. Equal sets are one vertex. Components are asked for, not pairs, so a
group of near copies never becomes all its pairs: first each vertex is verified
against the leaders of its min-hash groups (a few pairs a vertex), then the
prefix join looks only for pairs whose ends are not connected yet, and in an
n-gram's list only rows outside the list's largest component start a pair.
Every pair of unconnected vertices that could link is still verified.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.stage import stage
from .components import FILTER_BITS, connected_components, filter_slot, id_filter, slots_in
from .hashing import WordHashes, ascii_words, mix, shingle_hashes

SLOT_BITS = 20
# Min-hash leaders a vertex is verified against before the prefix join.
LEADERS = 4
CELLS = 64
# N-grams are hashes already: their low bits are their place in a filter.
LOW_BITS = (1 << FILTER_BITS) - 1
# Rows whose prefixes are spread out, or whose sets are built, at once.
SPREAD = 500


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in slices: whole batches of sets would be held twice, here and in the JVM."""
    for batch in batches:
        for first in range(0, len(batch), SPREAD):
            yield batch.slice(first, SPREAD)


def _slot_counts(docs: DataFrame, text: str, size: int) -> np.ndarray:
    """How many rows hold an n-gram of each slot: ``2 ** SLOT_BITS`` numbers."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, total = WordHashes(), np.zeros(1 << SLOT_BITS, np.int64)
        for batch in batches:
            for value in batch.column(0):
                grams = np.unique(shingle_hashes(memo.of(ascii_words(value.as_py())), size))
                slots = (grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
                np.add.at(total, slots, 1)
        used = np.flatnonzero(total)
        for at in range(0, len(used), 65536):
            part = used[at : at + 65536]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], ["slot", "n"])

    rows = docs.select(text).mapInArrow(count, "slot long, n long")
    # At most 2 ** SLOT_BITS rows, whatever the input.
    found = rows.groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << SLOT_BITS, np.int64)
    counts[found["slot"].to_numpy()] = found["n"].to_numpy()
    return counts


def prefix_length(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def _describe(docs: DataFrame, key: str, text: str, size: int, percent: int) -> DataFrame:
    """Per row: set size, class of equal sets, min-hashes, ordered prefix, histogram."""
    counts = docs.sparkSession.sparkContext.broadcast(_slot_counts(docs, text, size))
    seeds = mix(np.arange(1, LEADERS + 1, dtype=np.uint64))

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in _parts(batches):
            out = {k: [] for k in ("n", "class", "leads", "prefix", "cells")}
            for value in batch.column(1):
                grams = np.unique(shingle_hashes(memo.of(ascii_words(value.as_py())), size))
                n = len(grams)
                out["n"].append(n)
                if not n:
                    for k in ("class", "leads", "prefix", "cells"):
                        out[k].append(None)
                    continue
                rank = counts.value[(grams >> np.uint64(64 - SLOT_BITS)).astype(np.int64)]
                keep = prefix_length(n, percent)
                order = np.lexsort((grams, rank))[:keep]
                cells = np.bincount((mix(grams) % np.uint64(CELLS)).astype(np.int64), minlength=CELLS)
                out["class"].append(xxhash.xxh3_128_digest(grams.tobytes()))
                out["leads"].append([int(mix(grams ^ s).min().view(np.int64)) for s in seeds])
                out["prefix"].append(grams[order].view(np.int64))
                out["cells"].append(cells.tolist())
            kinds = (pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()))
            columns = [pa.array(v, t) for v, t in zip(out.values(), kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *out])

    schema = "id long, n long, class binary, leads array<long>, prefix array<long>, cells array<int>"
    rows = docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(describe, schema)


def _postings(rows: DataFrame, ids: Broadcast, grams: Broadcast | None = None) -> DataFrame:
    """``(v, n, at, h)``: the prefixes spread out, where both filters let them pass."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pa.array(slots_in(ids.value, batch.column(3).to_numpy())))
            for first in range(0, len(batch), SPREAD):
                part = batch.slice(first, SPREAD)
                h, sizes = part.column(2).flatten().to_numpy(), pc.list_value_length(part.column(2)).to_numpy()
                owner = np.repeat(np.arange(len(sizes)), sizes)
                at = np.arange(len(h)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                if grams is not None:
                    keep = slots_in(grams.value, h & LOW_BITS)
                    h, owner, at = h[keep], owner[keep], at[keep]
                own = pa.array(owner)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(own), part.column(1).take(own), pa.array(at, pa.int32()), pa.array(h)],
                    ["v", "n", "at", "h"],
                )

    rows = rows.select(F.col("id").alias("v"), "n", "prefix").withColumn("slot", filter_slot("v"))
    return rows.mapInArrow(spread, "v long, n long, at int, h long")


def _sets(docs: DataFrame, key: str, text: str, size: int, wanted: DataFrame) -> DataFrame:
    """The whole sets of the vertices in ``wanted`` (v); a few more may come along."""
    kept = id_filter(wanted, "v")

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = WordHashes()
        for batch in _parts(batches):
            batch = batch.filter(pa.array(slots_in(kept.value, batch.column(2).to_numpy())))
            sets = [
                np.unique(shingle_hashes(memo.of(ascii_words(t.as_py())), size)).view(np.int64)
                for t in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sets, pa.list_(pa.int64()))], ["v", "grams"]
            )

    rows = docs.select(F.col(key).cast("long").alias("v"), F.col(text).alias("text"))
    rows = rows.where(F.col("v").isNotNull()).withColumn("slot", filter_slot("v"))
    return rows.mapInArrow(build, "v long, grams array<long>")


def _verified(pairs: DataFrame, docs: DataFrame, key: str, text: str, size: int, percent: int):
    """Pairs (a, b) whose whole sets reach the threshold."""
    ends = pairs.select(F.explode(F.array("a", "b")).alias("v")).distinct()
    sets = stage(_sets(docs, key, text, size, ends), "sets")
    left = sets.select(F.col("v").alias("a"), F.col("grams").alias("_ga"))
    right = sets.select(F.col("v").alias("b"), F.col("grams").alias("_gb"))
    common = F.size(F.array_intersect("_ga", "_gb"))
    joined = pairs.join(left, "a").join(right, "b")
    union = F.size("_ga") + F.size("_gb") - common
    return joined.where(100 * common >= percent * union).select("a", "b")


def _need(percent: int) -> Column:
    """Smallest intersection of linking sets: percent / (100 + percent) of both sizes."""
    return F.ceil((F.col("n") + F.col("_n")) * percent / F.lit(100 + percent))


def _suffix_filter(pairs: DataFrame, sides: DataFrame, percent: int) -> DataFrame:
    """Drop pairs (a, b) whose sizes or histograms differ more than linking sets can."""
    pairs = pairs.join(sides.toDF("a", "_n", "_cells"), "a").join(sides.toDF("b", "n", "cells"), "b")
    apart = F.aggregate(
        F.zip_with("_cells", "cells", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x
    )
    small, large = F.least("n", "_n"), F.greatest("n", "_n")
    fits = (small * 100 >= large * percent) & (apart <= F.col("n") + F.col("_n") - 2 * _need(percent))
    return pairs.where(fits).select("a", "b").distinct()


def ngram_jaccard(
    docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = 4, percent: int = 85
) -> DataFrame:
    """``(key, n_shingles, component_id)`` for each row of ``docs``.

    Null, empty and wordless texts have no n-grams and link with nothing; a
    text of fewer than ``size`` words is one n-gram. Rows with equal keys are
    one vertex, repeated rows come back repeated; a null key links with nothing
    and has a null component. Other columns of any name are ignored.
    """
    rows = stage(_describe(docs, key, text, size, percent), "grams")
    full = rows.where((F.col("n") > 0) & F.col("id").isNotNull())
    # One vertex stands for each set: the least key that has it.
    classes = stage(full.groupBy("class").agg(F.min("id").alias("v")), "classes")
    vertices = classes.select("v").distinct()
    held = full.join(vertices.withColumnRenamed("v", "id"), "id", "left_semi")
    sides = held.select(F.col("id").alias("v"), "n", "cells")

    # 1. A few pairs a vertex: the leaders of its min-hash groups.
    led = stage(held.select(F.col("id").alias("v"), F.posexplode("leads").alias("k", "h")), "leads")
    leader = led.groupBy("k", "h").agg(F.min("v").alias("a"), F.max("v").alias("z"))
    leader = leader.where(F.col("a") < F.col("z")).drop("z")
    near = led.join(leader, ["k", "h"]).where(F.col("a") != F.col("v"))
    near = _suffix_filter(near.select("a", F.col("v").alias("b")).distinct(), sides, percent)
    first = _verified(stage(near, "near"), docs, key, text, size, percent)
    # Different sets under one key are one vertex, too.
    named = full.select("id", "class").join(classes, "class").groupBy("id")
    named = named.agg(F.min("v").alias("a"), F.collect_set("v").alias("vs")).where(F.size("vs") > 1)
    first = first.union(named.select("a", F.explode("vs").alias("b")).where("a <> b"))
    first = stage(first, "links")
    joined = connected_components(first)
    nodes = vertices.join(joined, "v", "left").select("v", F.coalesce("component", "v").alias("c"))

    # 2. The prefix join, over the lists that hold two components or more. An
    # n-gram of one row is in no such list; what is left meets the components.
    known = id_filter(vertices, "v")
    several = _postings(full, known).groupBy("h").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    several = id_filter(several.select("h"), "h", F.col("h").bitwiseAND(F.lit(LOW_BITS)))
    posts = stage(_postings(full, known, several).join(nodes, "v"), "postings")
    mixed = posts.groupBy("h").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
    mixed = mixed.where(F.col("lo") < F.col("hi")).select("h")
    posts = stage(posts.join(mixed, "h", "left_semi"), "posts")
    sized = posts.groupBy("h", "c").agg(F.count(F.lit(1)).alias("m"))
    main = sized.groupBy("h").agg(F.max(F.struct("m", "c"))["c"].alias("main"))
    minor = posts.join(main, "h").where(F.col("c") != F.col("main"))
    minor = minor.select("h", *[F.col(x).alias(f"_{x}") for x in ("v", "c", "n", "at")])
    small, large = F.least("n", "_n"), F.greatest("n", "_n")
    reach = 1 + F.least(F.col("n") - F.col("at") - 1, F.col("_n") - F.col("_at") - 1)
    found = posts.join(minor, "h").where(
        (F.col("c") != F.col("_c")) & (small * 100 >= large * percent) & (reach >= _need(percent))
    )
    pairs = found.select(F.least("v", "_v").alias("a"), F.greatest("v", "_v").alias("b")).distinct()
    pairs = _suffix_filter(stage(pairs, "pairs"), sides, percent)
    second = stage(_verified(stage(pairs, "pairs"), docs, key, text, size, percent), "links")

    linked = connected_components(stage(first.union(second), "links"))
    by_class = classes.join(linked, "v", "left").select(
        "class", F.coalesce("component", "v").alias("component")
    )
    shown = rows.join(by_class, "class", "left")
    return shown.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        F.coalesce("component", "id").alias("component_id"),
    )
