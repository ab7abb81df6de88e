"""Large glossaries: as many literal terms as a table can hold, found by joins.

Texts and terms meet on anchors: hashes of short windows, rolled over whole
texts. A term is listed under one anchor of its own, the rarest in the corpus.
Before anything is shuffled, windows are tested against a filter of fixed size
that knows the listed anchors, so only places that may begin a find travel, and
never their text. A term of one tenant is listed under an anchor that only
texts of that tenant form. What meets is compared character by character.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.stage import stage
from .detect import CANDIDATES

# Listed anchors up to this many bytes may be broadcast instead of shuffled.
BROADCAST_BYTES = 32 * 1024 * 1024
# Anchor lengths in characters, longest first; a term uses the longest that fits.
ANCHORS = (16, 8, 4, 2, 1)
# Windows of a term that may become its anchor, from its start.
CHOICES = 64
# Bits of an anchor filter: as many as stay sparse, at most eight megabytes whatever the number of terms.
LEAST_BITS, FILTER_BITS = 18, 26
# Slots in which windows of the corpus are counted.
SLOT_BITS = 20
# Characters hashed at once: what stays in a processor's cache.
PIECE = 1 << 16

_PRIME = np.uint64(0x9E3779B97F4A7C15)
_HIT = "struct<start:int,term:string,ty:string,priority:int>"


def distinct_terms(terms: DataFrame) -> DataFrame:
    """One entry per (tenant, term): the first listed supplies the metadata."""
    place = F.struct("term_ord", "ty", "priority")
    return (
        terms.where(F.length("term") > 0)
        .groupBy("tenant", "term")
        .agg(F.min(place).alias("_m"))
        .select("tenant", "term", "_m.*")
    )


# --- anchors ----------------------------------------------------------------


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le", "replace"), np.uint32)


def _windows(codes: np.ndarray, sizes: Sequence[int]) -> Iterator[tuple[int, np.ndarray]]:
    """``(size, hashes)`` of all windows of each size; sizes are powers of two."""
    size, h = 1, _mix(codes.astype(np.uint64) * _PRIME + np.uint64(1))
    while True:
        if size in sizes:
            yield size, _mix(h + np.uint64(size))
        if size >= max(sizes) or len(h) <= size:
            return
        h = _mix(h[:-size] * _PRIME + h[size:])
        size *= 2


def _owned(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """Anchors of a tenant's own terms; ``owner`` is a hash, never zero."""
    return _mix(h ^ owner)


def _owner_hash(tenant: Column) -> Column:
    return F.when(tenant.isNull(), F.lit(0).cast("bigint")).otherwise(F.xxhash64(tenant).bitwiseOR(F.lit(1)))


def _term_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (term number, owner, term) to all anchors that the term may be listed under."""
    for batch in batches:
        numbers, places, sizes, anchors = [], [], [], []
        owners = batch.column(1).to_numpy().view(np.uint64)
        for n, (term, owner) in enumerate(zip(batch.column(2).to_pylist(), owners)):
            size = next(q for q in ANCHORS if q <= len(term))
            ((_, h),) = _windows(_codes([term[: CHOICES + size]]), (size,))
            h = h[:CHOICES]
            numbers.append(np.full(len(h), n))
            places.append(np.arange(len(h), dtype=np.int32))
            sizes.append(np.full(len(h), size, np.int32))
            anchors.append(_owned(h, owner) if owner else h)
        if numbers:
            taken = batch.column(0).take(pa.array(np.concatenate(numbers)))
            columns = [taken, *[pa.array(np.concatenate(x)) for x in (places, sizes)], pa.array(np.concatenate(anchors).view(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["term_no", "place", "size", "anchor"])


def _slot(anchor: np.ndarray, bits: int) -> np.ndarray:
    return (anchor >> np.uint64(64 - bits)).astype(np.int64)


def _slot_column(anchor: Column, bits: int) -> Column:
    return F.shiftrightunsigned(anchor, 64 - bits)


class _Filter:
    """A filter of bounded size over hashes: it never loses one, and may let others through."""

    def __init__(self, packed: np.ndarray, bits: int):
        self.packed, self.bits = packed, bits

    def knows(self, anchors: np.ndarray) -> np.ndarray:
        """Places of the anchors that may be listed."""
        slots = (anchors >> np.uint64(64 - self.bits)).astype(np.int32)
        return np.flatnonzero((self.packed[slots >> 3] >> (slots & 7).astype(np.uint8)) & 1)


def _filter_of(anchors: DataFrame) -> Broadcast:
    many = anchors.count()
    bits = min(FILTER_BITS, max(LEAST_BITS, (64 * many).bit_length()))
    slots = anchors.select((_slot_column(F.col("anchor"), bits) + 1).alias("slot"))
    maps = slots.groupBy(F.bitmap_bucket_number("slot").alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("slot")).alias("bits")
    )
    packed = np.zeros((1 << bits) // 8, np.uint8)
    # At most 2 ** FILTER_BITS / 32768 buckets of 4 KB.
    found = maps.toArrow()
    for bucket, part in zip(found["bucket"].to_pylist(), found["bits"].to_pylist()):
        packed[(bucket - 1) * 4096 : bucket * 4096] = np.frombuffer(part, np.uint8)
    return anchors.sparkSession.sparkContext.broadcast(_Filter(packed, bits))


def _wanted(batch: pa.RecordBatch, known: _Filter, sizes: Sequence[int]):
    """``(row, place, anchor)`` arrays of the windows that the filter knows; owner and text come last."""
    texts = batch.column(batch.num_columns - 1).to_pylist()
    owners = batch.column(batch.num_columns - 2).to_numpy().view(np.uint64)
    row = 0
    while row < len(texts):
        end, chars = row, 0
        while end < len(texts) and (end == row or chars + len(texts[end]) <= PIECE):
            chars += len(texts[end])
            end += 1
        lengths = np.array([len(t) for t in texts[row:end]])
        ends = np.cumsum(lengths)
        own = np.repeat(owners[row:end], lengths) if owners[row:end].any() else None
        for size, h in _windows(_codes(texts[row:end]), sizes) if chars else ():
            for mine in (None,) if own is None else (None, own[: len(h)]):
                anchors = h if mine is None else _owned(h, mine)
                hit = known.knows(anchors)
                of = np.searchsorted(ends, hit, side="right")
                # Windows do not reach into the next text.
                fits = hit + size <= ends[of]
                if mine is not None:
                    fits &= mine[hit] != 0
                hit, of = hit[fits], of[fits]
                yield row + of, hit - (ends - lengths)[of], anchors[hit]
        row = end


def _counts(packed: Broadcast, sizes: Sequence[int]):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [_slot(anchors, SLOT_BITS) for _, _, anchors in _wanted(batch, packed.value, sizes)]
            slots, n = np.unique(np.concatenate([np.empty(0, np.int64), *found]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(n.astype(np.int64))], ["slot", "n"])

    return count


def _candidates(packed: Broadcast, sizes: Sequence[int]):
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.num_columns - 2
            parts = [*zip(*_wanted(batch, packed.value, sizes))]
            if not parts:
                continue
            rows, at, anchors = (np.concatenate(p) for p in parts)
            taken = [batch.column(i).take(pa.array(rows)) for i in range(keys)]
            found = [pa.array(at.astype(np.int32)), pa.array(anchors.view(np.int64))]
            yield pa.RecordBatch.from_arrays([*taken, *found], [*batch.schema.names[:keys], "_at", "anchor"])

    return find


# --- joins ------------------------------------------------------------------


def _listed(texts: DataFrame, terms: DataFrame) -> tuple[DataFrame, tuple[int, ...]]:
    """Each term under the rarest of its anchors, and the sizes in use."""
    name = F.struct(F.xxhash64("tenant", "term").alias("a"), F.xxhash64("term", F.lit(1), "tenant").alias("b"))
    numbered = terms.withColumn("term_no", name)
    owner = _owner_hash(F.col("tenant"))
    every = numbered.select("term_no", owner.alias("owner"), "term").mapInArrow(
        _term_anchors, "term_no struct<a:bigint,b:bigint>, place int, size int, anchor bigint"
    )
    every = stage(every, "anchors")
    # One row per anchor length.
    sizes = tuple(sorted(r["size"] for r in every.select("size").distinct().collect()))
    if not sizes:
        return terms.select("*", F.lit(0).alias("place"), F.lit(0).cast("bigint").alias("anchor")).limit(0), sizes
    packed = _filter_of(every)
    counted = texts.select("_owner", "_text").mapInArrow(_counts(packed, sizes), "slot bigint, n bigint")
    counts = counted.groupBy("slot").agg(F.sum("n").alias("n"))
    placed = every.withColumn("slot", _slot_column(F.col("anchor"), SLOT_BITS)).join(counts, "slot", "left")
    rarity = F.struct(F.coalesce("n", F.lit(0)).alias("n"), "place", "anchor")
    chosen = placed.groupBy("term_no").agg(F.min(rarity).alias("_r")).select("term_no", "_r.place", "_r.anchor")
    return stage(numbered.join(chosen, "term_no").drop("term_no"), "listed"), sizes


def _joined_hits(
    df: DataFrame, terms: DataFrame, key: Sequence[str], text: str, tenant: str | None, limit: int
) -> DataFrame:
    """Keys and ``_hits``: places of each text where a term may stand."""
    owner = F.col(tenant).cast("string") if tenant else F.lit(None).cast("string")
    names = [f"_hit_key{i}" for i in range(len(key))]
    texts = df.select(
        *[F.col(k).alias(n) for k, n in zip(key, names)], owner.alias("_tenant"), _owner_hash(owner).alias("_owner"), F.col(text).alias("_text")
    ).where(F.col("_text").isNotNull())
    listed, sizes = _listed(texts, terms)
    kind = T.StructType([*texts.select(*names, "_tenant").schema.fields, T.StructField("_at", T.IntegerType()), T.StructField("anchor", T.LongType())])
    if not sizes:
        return df.sparkSession.createDataFrame([], T.StructType(kind.fields[: len(names)])).withColumn("_hits", F.array().cast(f"array<{_HIT}>"))
    places = texts.mapInArrow(_candidates(_filter_of(listed), sizes), kind)
    bytes_ = listed.agg(F.sum(F.octet_length("term") + 64).alias("n")).first()["n"] or 0
    right = listed.withColumnRenamed("tenant", "_of")
    met = places.join(F.broadcast(right) if bytes_ <= limit else right, "anchor")
    mine = (F.col("_of").isNull() | (F.col("_of") == F.col("_tenant"))) & (F.col("_at") >= F.col("place"))
    hit = F.struct(
        (F.col("_at") - F.col("place")).cast("int").alias("start"), "term_ord", "term", "ty", F.col("priority").cast("int").alias("priority")
    )
    # By start, then as listed; the order itself may be of any type and goes no further.
    listed_first = F.array_sort(F.collect_list(hit))
    bare = F.transform(
        listed_first, lambda h: F.struct(h["start"].alias("start"), h["term"].alias("term"), h["ty"].alias("ty"), h["priority"].alias("priority"))
    )
    return met.where(mine).groupBy(*names).agg(bare.alias("_hits"))


_SPAN = T.StructType()
for _name in ("start", "end", "byte_start", "byte_end"):
    _SPAN = _SPAN.add(_name, T.IntegerType())
_SPAN = _SPAN.add("ty", T.StringType()).add("priority", T.IntegerType()).add("detector", T.StringType())


@F.pandas_udf(T.ArrayType(_SPAN))
def _settle(text: pd.Series, hits: pd.Series) -> pd.Series:
    """True hits, leftmost-longest, then first listed, with byte offsets."""

    def one(t, found):
        if t is None or found is None:
            return []
        real = [
            (h["start"], -len(h["term"]), n, h["ty"], h["priority"])
            for n, h in enumerate(found)
            if t.startswith(h["term"], h["start"])
        ]
        kept, reach = [], 0
        at = at_bytes = 0
        for start, neg, _, ty, priority in sorted(real, key=lambda h: h[:3]):
            if start < reach:
                continue
            reach = start - neg
            begin = at_bytes + len(t[at:start].encode("utf-8", "replace"))
            end = begin + len(t[start:reach].encode("utf-8", "replace"))
            at, at_bytes = reach, end
            kept.append({"start": start, "end": reach, "byte_start": begin, "byte_end": end, "ty": ty, "priority": priority, "detector": "literal"})
        return kept

    return pd.Series([one(t, h) for t, h in zip(text, hits)])


def detect_literals_large(
    df: DataFrame,
    terms: DataFrame,
    key: Sequence[str],
    text: str = "text",
    tenant: str | None = None,
    out: str = "spans",
    limit: int = BROADCAST_BYTES,
) -> DataFrame:
    """Add the leftmost-longest glossary hits as column ``out``.

    ``terms`` has columns ``term_ord, term, ty, priority, tenant``; a term with
    a tenant counts only in rows of that tenant. ``key`` names a row. The text is
    read twice where it lies (to count anchors, and to find them); listed terms
    of up to ``limit`` bytes are broadcast to it, more are shuffled. Only rows
    with a hit are compared and joined.
    """
    found = _joined_hits(df, distinct_terms(terms), key, text, tenant, limit)
    same = None
    for i, k in enumerate(key):
        match = F.col(k).eqNullSafe(F.col(f"_hit_key{i}"))
        same = match if same is None else same & match
    met = df.join(found, same, "left").drop(*[f"_hit_key{i}" for i in range(len(key))])
    hit = F.col("_hits").isNotNull()
    spans = _settle(F.when(hit, F.col(text)), F.col("_hits"))
    return met.withColumn(out, F.when(hit, spans).otherwise(F.array().cast(CANDIDATES))).drop("_hits")
