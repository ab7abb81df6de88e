"""Best-fit packing of token sequences by the linear grouping scheme.

Texts become token ids with an end mark; longer ones are cut. Only how many
pieces there are of each length, at most ``capacity`` numbers, reaches the
driver. There, large lengths are cut into groups of equal cardinality and
rounded up to the longest of their group; a configuration program over these
few sizes is solved by column generation; the pieces themselves take the places
of the rounded sizes; and small and left-over lengths go, longest first, where
they leave the least room. The result is a table of runs: so many pieces of one
length to so many sequences. Each piece finds its run by its rank among the
pieces of its length.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.stage import stage

CAPACITY = 1024
END = 2
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
# Lengths up to a quarter of the capacity are small.
SMALL = 4
GROUPS = 96
# Configurations with more room than this may be given up.
ROOMS = (0, 1, 2, 4, 8, 16, 64, 1024)
ROUNDS = 3000
# White space of so many characters in one go is left to the tokenizer itself.
LONG_BLANK = 65_536


@lru_cache(maxsize=2)
def encoder(tokenizer: str, ranks: str | None):
    """Text to ids. ``ranks`` holds the vocabulary of ``tokenizer`` for a faster reader.

    Where a text spells one of the tokenizer's special tokens, the tokenizer
    itself reads it, because only it knows them; and where white space is
    longer than ``LONG_BLANK``, because the faster reader ends the process there.
    """
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(tokenizer)

    def read(text: str) -> np.ndarray:
        return np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)

    if ranks is None:
        return read
    import tiktoken

    with open(ranks, "rb") as lines:
        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})
    special = [t.content for t in slow.get_added_tokens_decoder().values()]

    def read_fast(text: str) -> np.ndarray:
        # The faster reader breaks down on very long white space.
        blank = len(text) > LONG_BLANK and max(map(len, re.findall(r"\s+", text)), default=0) > LONG_BLANK
        if blank or any(s in text for s in special):
            return read(text)
        return np.array(fast.encode_ordinary(text), np.uint32)

    return read_fast


def pieces_of(
    docs: DataFrame, key: str, text: str, capacity: int, tokenizer: str, ranks: str | None, with_ids: bool
) -> DataFrame:
    """Pieces of every row, numbered within their task and length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part = encoder(tokenizer, ranks), TaskContext.get().partitionId()
        used = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            row, piece, start, length, crc, nth, ids = [], [], [], [], [], [], []
            for i, value in enumerate(batch.column(1)):
                own = np.append(encode(value.as_py() or ""), np.uint32(END)).astype("<u4")
                # Only the first piece may be shorter.
                first = (len(own) - 1) % capacity + 1
                edges = [0, *range(first, len(own) + 1, capacity)]
                for k, (a, b) in enumerate(zip(edges, edges[1:])):
                    row.append(i)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(own[a:b].tobytes()))
                    nth.append(used[b - a])
                    used[b - a] += 1
                    if with_ids:
                        ids.append(own[a:b].astype(np.int32))
            columns = [
                batch.column(0).take(pa.array(row, pa.int64())),
                pa.array(piece, pa.int32()),
                *(pa.array(x, pa.int64()) for x in (start, length, crc)),
                pa.array([part] * len(row), pa.int64()),
                pa.array(nth, pa.int64()),
                *([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    names = ["key", "piece", "start", "length", "ids_crc32", "part", "nth", *(["ids"] if with_ids else [])]
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    schema = f"key {rows.schema['key'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long, part long, nth long"
    return rows.mapInArrow(cut, schema + (", ids array<int>" if with_ids else ""))


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """The multiset of sizes within the capacity that is worth most."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        fit = int(np.searchsorted(-sizes, -room, side="left"))
        if fit < len(sizes):
            value = best[room - sizes[fit:]] + worth[fit:]
            i = int(value.argmax())
            if value[i] > best[room] + 1e-12:
                best[room], taken[room] = value[i], fit + i
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= sizes[taken[room]]
    return pattern


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """Patterns over descending ``sizes`` and how often each is used, rounded down.

    The linear program "fewest sequences that hold ``demand``", by column
    generation; it ends when no pattern improves it or the bound is met.
    """
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(ROUNDS):
        amount = np.linalg.solve(basis, demand)
        worth = np.linalg.solve(basis.T, np.ones(len(sizes)))
        pattern = _best_pattern(sizes, np.maximum(worth, 0), capacity)
        value = pattern @ worth
        if value <= 1 + 1e-7 or amount.sum() * (1 - 1 / value) < 0.5:
            break
        along = np.linalg.solve(basis, pattern)
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(along > 1e-9, np.maximum(amount, 0) / along, np.inf)
        basis[:, int(ratio.argmin())] = pattern
    amount = np.floor(np.maximum(np.linalg.solve(basis, demand), 0) + 1e-7).astype(np.int64)
    return [(basis[:, i].astype(np.int64), int(n)) for i, n in enumerate(amount) if n]


# So many sequences, each with the same pieces: (length, how many of it).
Block = tuple[int, tuple[tuple[int, int], ...]]


def _room(block: Block, capacity: int) -> int:
    return capacity - sum(x * m for x, m in block[1])


def best_fit(left: dict[int, int], blocks: list[Block], capacity: int) -> list[Block]:
    """``blocks`` and ``left``'s pieces, longest first, each where it leaves the least room."""
    rooms: dict[int, list[Block]] = {}
    for b in blocks:
        rooms.setdefault(_room(b, capacity), []).append(b)
    for length in sorted(left, reverse=True):
        n = left[length]
        while n:
            fit = min((r for r, bs in rooms.items() if bs and r >= length), default=None)
            if fit is None:
                fit = capacity
                rooms.setdefault(fit, []).append((-(-n // (capacity // length)), ()))
            many, items = rooms[fit].pop()
            each = min(fit // length, n)
            full = min(many, n // each)
            if many > full:
                rooms[fit].append((many - full, items))
            rooms.setdefault(fit - each * length, []).append((full, (*items, (length, each))))
            n -= each * full
    return [b for bs in rooms.values() for b in bs]


def _grouped(left: dict[int, int], capacity: int, groups: int) -> list[Block]:
    """Blocks of large pieces from the configuration program; takes them off ``left``."""
    large = sorted((k for k in left if k > capacity // SMALL), reverse=True)
    # Equal cardinality: every group has the same number of pieces but for the last.
    quota = max(1, -(-sum(left[k] for k in large) // groups))
    members: dict[int, list[list[int]]] = {}
    size, room = 0, 0
    for length in large:
        n = left[length]
        while n:
            if not room:
                size, room = length, quota
            part = min(n, room)
            members.setdefault(size, []).append([length, part])
            n, room = n - part, room - part
    if not members:
        return []
    held, sizes = list(members.values()), np.array(list(members))
    demand = np.array([sum(n for _, n in g) for g in held], float)
    blocks: list[Block] = []
    for pattern, times in configurations(sizes, demand, capacity):
        # Actual lengths take the places of the rounded ones, each place longest first.
        places = []
        for j in np.repeat(np.arange(len(sizes)), pattern):
            ends, at = [], 0
            while at < times and held[j]:
                part = min(times - at, held[j][0][1])
                at += part
                ends.append((at, held[j][0][0]))
                left[held[j][0][0]] -= part
                held[j][0][1] -= part
                if not held[j][0][1]:
                    held[j].pop(0)
            places.append(ends)
        at = 0
        for end in sorted({e for ends in places for e, _ in ends}):
            items = (next((x for e, x in ends if e >= end), None) for ends in places)
            blocks.append((end - at, tuple((x, 1) for x in items if x)))
            at = end
    return blocks


def plan(counts: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS) -> list[tuple[int, ...]]:
    """Runs ``(length, rank, end, sequence, per_sequence, offset)`` for all pieces.

    Pieces of ``length`` with ranks from ``rank`` up to ``end`` go to sequences
    from ``sequence`` on, ``per_sequence`` to each, from ``offset`` on.
    Configurations that actual pieces leave with more than some room are given
    up and their pieces best-fit with the small ones, for the room that saves most.
    """
    left = {k: n for k, n in counts.items() if n}
    blocks = _grouped(left, capacity, groups)
    best: list[Block] | None = None
    for most in ROOMS:
        loose = dict(left)
        for n, items in (b for b in blocks if _room(b, capacity) > most):
            for length, each in items:
                loose[length] = loose.get(length, 0) + n * each
        packed = best_fit(loose, [b for b in blocks if _room(b, capacity) <= most], capacity)
        if best is None or sum(n for n, _ in packed) < sum(n for n, _ in best):
            best = packed
    rank, runs, total = dict.fromkeys(counts, 0), [], 0
    for n, items in best:
        offset = 0
        for length, each in items:
            runs.append((length, rank[length], rank[length] + n * each, total, each, offset))
            rank[length] += n * each
            offset += length * each
        total += n
    return runs


def pack(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    capacity: int = CAPACITY,
    tokenizer: str = TOKENIZER,
    ranks: str | None = RANKS,
    with_ids: bool = False,
) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, sequence_id, offset)`` of every piece.

    ``with_ids`` adds the piece's token ids. A null text is empty: its piece is
    the end mark alone. Repeated rows are packed each; no rows give no rows.
    """
    spark = docs.sparkSession
    rows = stage(pieces_of(docs, key, text, capacity, tokenizer, ranks, with_ids), "pieces")
    per_task = stage(rows.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    # At most ``capacity`` rows.
    counts = {r["length"]: r["n"] for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = per_task.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("shift"))
    runs = spark.createDataFrame(
        plan(counts, capacity), "length long, first long, end long, sequence long, each long, place long"
    )
    ranked = rows.join(shifts, ["part", "length"]).withColumn("rank", F.col("nth") + F.col("shift"))
    # The plan's size depends on the capacity and the groups, not on the rows.
    inside = (ranked["length"] == runs["length"]) & (ranked["rank"] >= runs["first"]) & (ranked["rank"] < runs["end"])
    met = ranked.join(F.broadcast(runs), inside)
    step = F.col("rank") - F.col("first")
    return met.select(
        F.col("key").alias(key),
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("sequence") + F.call_function("div", step, F.col("each"))).alias("sequence_id"),
        (F.col("place") + step % F.col("each") * ranked["length"]).alias("offset"),
        *(["ids"] if with_ids else []),
    )
