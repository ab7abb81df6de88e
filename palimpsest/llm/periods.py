"""Periodic runs of words: multi-scale minimizers, extended word by word.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q``
apart are equal), at least ``least`` and ``2 * q`` words long, that no word
beside it prolongs. All runs are found, whatever their period:

* Periods below ``SHORT`` (or ``2 * least``, if more) come from direct lag scans: words are
  compared with those ``q`` places on, and stretches of at least ``q`` equal pairs are runs.
* Scale ``k`` finds periods from ``2 ** k`` to below ``2 ** (k + 1)``. Words are
  hashed in grams of ``t = 2 ** (k - 1)`` and the least gram of each window of
  ``t + 1`` is kept. Such a window fits into every stretch that a run repeats,
  and its copy one period on has the same least gram, so two equal minimizers
  lie exactly one period apart. Each such pair is prolonged both ways.
* A gram that itself has a period of at most ``t / 2`` is no minimizer: it would
  pair with itself all along its own run. Other equal grams are over ``t / 2``
  apart, which leaves at most eight partners in reach. A run that repeats
  nothing but such grams repeats a piece of one shorter run inside the next
  one of the same period that touches it; those two meet by ends alone.

The cost of a text grows with its words times the number of scales. Hashes
only propose: every run is compared word by word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.expr import let
from .hashing import mix

# Periods below are scanned lag by lag; the first scale begins here.
SHORT = 32
# Words that are searched in one piece; a longer text is one piece of its own.
PIECE_WORDS = 1_000_000
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_NEVER = np.uint64(2**64 - 1)

RUNS = T.ArrayType(
    T.StructType().add("start", T.LongType()).add("length", T.LongType()).add("period", T.LongType())
)


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        self[word] = number = len(self)
        return number


def _equal_right(a: np.ndarray, i: int, j: int) -> int:
    """Length of the longest equal stretch that begins at ``i`` and ``j > i``."""
    done, step = 0, 64
    while j + done < len(a):
        x, y = a[i + done : i + done + step], a[j + done : j + done + step]
        same = x[: len(y)] == y
        if not same.all():
            return done + int(np.argmin(same))
        done, step = done + len(y), step * 2
    return done


def _equal_left(a: np.ndarray, i: int, j: int) -> int:
    """Length of the longest equal stretch that ends before ``i`` and ``j > i``."""
    done, step = 0, 64
    while done < i:
        step = min(step, i - done)
        same = a[i - done - step : i - done] == a[j - done - step : j - done]
        if not same.all():
            return done + int(np.argmin(same[::-1]))
        done, step = done + step, step * 2
    return done


class _Runs:
    """Runs found so far, as ``start, end -> period``; periods come ascending."""

    def __init__(self, least: int):
        self.least, self.found = least, {}

    def add(self, start: int, end: int, period: int) -> None:
        # The same stretch under a multiple of its period is no new run.
        if end - start >= max(self.least, 2 * period):
            self.found.setdefault((start, end), period)


def _lag_scan(a: np.ndarray, lag: int, runs: _Runs) -> None:
    places = np.flatnonzero(a[:-lag] == a[lag:])
    if not len(places):
        return
    cuts = np.flatnonzero(np.diff(places) != 1)
    first = places[np.concatenate(([0], cuts + 1))]
    last = places[np.concatenate((cuts, [len(places) - 1]))]
    long = last - first + 1 >= max(runs.least - lag, lag)
    for s, e in zip(first[long].tolist(), last[long].tolist()):
        runs.add(s, e + 1 + lag, lag)


def _minimizers(grams: np.ndarray, banned: np.ndarray, window: int) -> np.ndarray:
    """Places of the least gram (the leftmost one) of each window."""
    bits = np.uint64(len(grams).bit_length())
    packed = (grams >> bits << bits) | np.arange(len(grams), dtype=np.uint64)
    packed[banned] = _NEVER
    width = 1
    while width < window and len(packed) > width:
        step = min(width, window - width)
        packed = np.minimum(packed[:-step], packed[step:])
        width += step
    packed = packed[packed != _NEVER]
    if not len(packed):
        return np.empty(0, np.int64)
    fresh = np.concatenate(([True], packed[1:] != packed[:-1]))
    return (packed[fresh] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)


def _seeds(grams: np.ndarray, at: np.ndarray, owner: np.ndarray, low: int) -> np.ndarray:
    """Distinct ``(distance, place)`` of equal minimizers of one text, ``low`` to below ``2 * low`` apart."""
    values = grams[at]
    order = np.argsort(values, kind="stable")
    values, at = values[order], at[order]
    pairs = []
    for j in range(1, len(at)):
        gap = at[j:] - at[:-j]
        near = (values[j:] == values[:-j]) & (gap < 2 * low) & (gap > 0)
        if not near.any():
            break
        near &= (gap >= low) & (owner[at[j:]] == owner[at[:-j]])
        pairs.append(np.stack([gap[near], at[:-j][near]], axis=1))
    if not pairs:
        return np.empty((0, 2), np.int64)
    return np.unique(np.concatenate(pairs), axis=0)


def _touching(a: np.ndarray, known: list[tuple[int, int, int]], low: int, runs: _Runs) -> None:
    """Runs that repeat a piece of one short run inside the next one, for periods of one scale."""
    known.sort(key=lambda r: (r[2], r[0]))
    for (s, e, p), (u, v, other) in pairwise(known):
        if p != other or u > e:
            continue
        unit, ring = a[u : u + p].tobytes(), a[s : s + 2 * p - 1].tobytes()
        at = ring.find(unit)
        while at > 0 and at % a.itemsize:
            at = ring.find(unit, at + 1)
        if at < 0:
            continue
        most = min(e - s, v - u, (v - s) // 2, 2 * low - 1)
        shift = u - (s + at // a.itemsize)
        for q in range(low + (shift - low) % p, most + 1, p):
            left, right = max(s, u - q), min(e, v - q)
            if right - left < q:
                continue
            # Only where both short runs begin, or end, can the stretch go on.
            if s == u - q:
                left -= _equal_left(a, left, left + q)
            if e == v - q:
                right += _equal_right(a, right, right + q)
            runs.add(left, right + q, q)


def all_runs(texts: list[np.ndarray], least: int) -> list[list[tuple[int, int, int]]]:
    """``(start, length, period)`` of every run of each text, texts given as word numbers >= 0."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    # Longest first: what a scale needs is always the front of the array.
    order = sorted((i for i, t in enumerate(texts) if len(t) >= least), key=lambda i: -len(texts[i]))
    if not order:
        return out
    sizes = np.array([len(texts[i]) for i in order])
    starts = np.concatenate(([0], np.cumsum(sizes + 1)))
    # A word of its own after each text keeps runs apart.
    a = np.concatenate([np.append(texts[i], -1 - n) for n, i in enumerate(order)]).astype(np.int64)
    owner = np.repeat(np.arange(len(order), dtype=np.int32), sizes + 1)
    runs = _Runs(least)
    # The first scale's grams are no shorter than a run, so that the run of every banned gram is known.
    low, gram, grams = SHORT, 1, None
    while low < 2 * least:
        low *= 2

    def front(length: int) -> int:
        return int(starts[np.searchsorted(-sizes, -length, side="right")])

    for lag in range(1, low):
        end = front(max(least, 2 * lag))
        if end > lag:
            _lag_scan(a[:end], lag, runs)
    while (end := front(2 * low)) > 0:
        t = low // 2
        if grams is None:
            grams = mix(a[:end].view(np.uint64) * _PRIME)
        grams = grams[:end]
        while gram < t:
            grams = mix(grams[:-gram] * _PRIME + grams[gram:])
            gram *= 2
        banned = np.zeros(len(grams), bool)
        short = [(s, e, p) for (s, e), p in runs.found.items() if p <= t // 2 and e - s >= t and s < end]
        for s, e, _ in short:
            banned[s : e - t + 1] = True
        seen = (0, 0)
        for d, at in _seeds(grams, _minimizers(grams, banned, t + 1), owner, low).tolist():
            if d == seen[0] and at < seen[1]:
                continue
            s, e = at - _equal_left(a, at, at + d), at + _equal_right(a, at, at + d)
            seen = (d, e)
            if e - s >= d:
                runs.add(s, e + d, d)
        _touching(a, [r for r in short if r[1] - r[0] >= low], low, runs)
        low *= 2
    for (s, e), p in runs.found.items():
        n = int(np.searchsorted(starts, s, side="right")) - 1
        out[order[n]].append((s - int(starts[n]), e - s, p))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def _pieces(texts: pa.Array) -> Iterator[list[list[bytes]]]:
    piece, words = [], 0
    for text in texts.to_pylist():
        # Bytes are split at ASCII white space alone.
        piece.append(text.encode("utf-8", "replace").split() if text else [])
        words += len(piece[-1])
        if words >= PIECE_WORDS:
            yield piece
            piece, words = [], 0
    if piece:
        yield piece


def _scan(least: int):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def columns(texts: pa.Array) -> list[pa.Array]:
        found, counts, collapsed = [], [], []
        for piece in _pieces(texts):
            numbers = _Numbers()
            ids = [np.fromiter(map(numbers.__getitem__, w), np.int64, len(w)) for w in piece]
            for words, runs in zip(piece, all_runs(ids, least)):
                found.append([dict(zip(("start", "length", "period"), r)) for r in runs])
                counts.append(len(words))
                if runs:
                    keep = np.ones(len(words), bool)
                    for start, length, period in runs:
                        keep[start + period : start + length] = False
                    words = [words[i] for i in np.flatnonzero(keep).tolist()]
                collapsed.append(b" ".join(words).decode())
        return [pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(collapsed, pa.string())]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rest = [batch.column(i) for i in range(batch.num_columns - 1)]
            names = [*batch.schema.names[:-1], "n_words", "runs", "collapsed"]
            yield pa.RecordBatch.from_arrays(rest + columns(batch.column(batch.num_columns - 1)), names)

    return scan


def periodic_runs(docs: DataFrame, key: str = "doc_id", text: str = "text", least: int = 12) -> DataFrame:
    """Every periodic run of each text: ``key``, ``n_words``, ``runs``, ``collapsed``.

    Words are what stands between ASCII white space. ``runs`` lists start
    (word number from 0), length and period by start, then period;
    ``collapsed`` is the text without the repeats: the words that no run
    holds behind its first period, joined by one space. One row per row of
    ``docs``; no shuffle. A null or empty text has no words, no runs and an
    empty ``collapsed``. Null and repeated keys are kept as they are; other
    columns of ``docs`` are not read.
    """
    if least < 2:
        raise ValueError("a run has two words at least")
    rows = docs.select(F.col(key), F.col(text).cast("string").alias("_text"))
    schema = T.StructType([*docs.select(key).schema.fields, T.StructField("n_words", T.LongType())])
    schema = schema.add("runs", RUNS).add("collapsed", T.StringType())
    return rows.mapInArrow(_scan(least), schema)


def with_planted_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the words of one text in ten, by the hash of its key, repeated from some place on.

    With ``h`` the CRC-32 of the key's digits and ``g = h div 10``, a text of
    ``n > 0`` words and ``h % 10 = 0`` gets the words ``a + (i - a) % p`` from
    ``a = g % n`` on, ``p = 1 + (n - a) div (3 + g % 8)``. A null key or text
    is left alone.
    """
    h = F.crc32(F.col(key).cast("string").cast("binary"))
    g = F.call_function("div", h, F.lit(10))
    words = F.regexp_extract_all(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))

    def repeat(w: Column) -> Column:
        n = F.size(w).cast("bigint")
        a = F.pmod(g, n)
        p = 1 + F.call_function("div", n - a, 3 + F.pmod(g, F.lit(8)))

        def put(v: Column) -> Column:
            def word(x: Column, i: Column) -> Column:
                return F.when(i < v["a"], x).otherwise(F.get(w, (v["a"] + F.pmod(i - v["a"], v["p"])).cast("int")))

            return F.array_join(F.transform(w, word), " ")

        return F.when(n > 0, let(F.struct(a.alias("a"), p.alias("p")), put)).otherwise(F.lit(""))

    planted = F.when((F.pmod(h, F.lit(10)) == 0) & F.col(text).isNotNull(), let(words, repeat))
    return docs.withColumn(text, F.coalesce(planted, F.col(text)))


def run_report(docs: DataFrame) -> DataFrame:
    """Longest run (ties: smallest start, then period) and digests of each document."""
    rows = periodic_runs(docs)
    best = F.array_min(F.transform("runs", lambda r: F.struct(-r["length"], r["start"], r["period"])))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    length, period = -F.col("_best.col1"), F.col("_best.period")
    return rows.withColumn("_best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("_best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.call_function("div", 1000 * length, period).alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )

