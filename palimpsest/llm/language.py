"""Language identification by string kernels.

The blended spectrum kernel of two texts counts the character 2- to 4-grams
that both have, whatever their number, over the root of the two set sizes. A
few landmark texts of each language span a Nyström feature space; one-versus-
rest kernel ridge regression in it gives a weight for each landmark and
language. Scoring is a product of a batch's presence matrix with the landmarks'
and with these weights.

Only the fit is bounded: about ``PER_LANG`` texts a language, at most
``MOST`` in all, those whose key hashes lowest.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS = 17
ORDERS = (2, 3, 4)
PER_LANG, LANDMARKS, MOST = 300, 24, 4000
RIDGE = 1e-3
BATCH = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Each code point, or a space if it is no letter."""
    table = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        if chr(c).isalpha():
            table[c] = c
    return table


def presence(text: str | None, out: np.ndarray) -> bool:
    """Mark the n-gram buckets of a whole text in ``out``; false if it has no letter."""
    points = np.frombuffer((text or "").lower().encode("utf-32-le", "replace"), np.uint32)
    points = _letters()[points]
    if not (points != 32).any():
        return False
    points = np.concatenate(([np.uint32(32)], points, [np.uint32(32)]))
    value = points * np.uint32(0x9E3779B1)
    for n in range(2, ORDERS[-1] + 1):
        value = (value[:-1] ^ (value[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + points[n - 1 :] * np.uint32(0xC2B2AE35)
        if n in ORDERS:
            out[((value ^ (value >> np.uint32(13))) * np.uint32(0x27D4EB2F)) >> np.uint32(32 - BITS)] = True
    return True


@dataclass(frozen=True)
class LanguageModel:
    languages: tuple[str, ...]
    columns: np.ndarray  # buckets that some landmark has
    landmarks: np.ndarray  # columns x landmarks, scaled by the landmarks' set sizes
    weights: np.ndarray  # landmarks x languages

    def scores(self, marks: np.ndarray) -> np.ndarray:
        sizes = np.sqrt(np.maximum(marks.sum(1), 1)).astype(np.float32)
        kernel = marks[:, self.columns].astype(np.float32) @ self.landmarks
        return np.clip(kernel / sizes[:, None] @ self.weights, 0, 1)


def fit(marks: np.ndarray, languages: Sequence[str]) -> LanguageModel | None:
    """Nyström features of the marks and ridge regression on them; None without rows."""
    names = tuple(sorted(set(languages)))
    if not names:
        return None
    truth = np.array([[a == b for b in names] for a in languages], float)
    chosen = np.concatenate([np.flatnonzero(t)[:LANDMARKS] for t in truth.T])
    columns = np.flatnonzero(marks[chosen].any(0))
    sizes = np.sqrt(np.maximum(marks.sum(1), 1))
    base = (marks[np.ix_(chosen, columns)] / sizes[chosen, None]).T.astype(np.float32)
    kernel = marks[:, columns].astype(np.float32) @ base / sizes[:, None]
    inner = kernel[chosen].astype(float)
    value, vector = np.linalg.eigh((inner + inner.T) / 2)
    good = value > 1e-8 * value.max()
    root = vector[:, good] / np.sqrt(value[good])
    features = kernel @ root
    # Languages weigh alike, whatever their number of rows.
    weight = (truth / np.maximum(truth.sum(0), 1)).sum(1)
    left = features.T @ (features * weight[:, None]) + RIDGE * np.eye(features.shape[1])
    solved = np.linalg.solve(left, features.T @ (truth * weight[:, None]))
    return LanguageModel(names, columns, base, (root @ solved).astype(np.float32))


def held_out(key: str) -> Column:
    """Rows kept from training: the key's crc32 leaves two by four. Null keys are."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 4 == 2, F.lit(True))


def train(docs: DataFrame, key: str, text: str, lang: str) -> LanguageModel | None:
    rows = docs.where(F.col(key).isNotNull() & F.col(text).isNotNull() & F.col(lang).isNotNull())
    rows = rows.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text).alias("h"))
    # Rows are chosen by key and hash; only the chosen ones' texts travel.
    names = rows.select("k", "l", "h").distinct()
    counts = names.groupBy("l").agg(F.count(F.lit(1)).alias("n"))
    rank = F.pmod(F.xxhash64("k"), F.lit(1 << 40))
    near = names.join(counts, "l").where(rank * F.col("n") < F.lit(PER_LANG) * F.lit(float(1 << 40)))
    # Each language's ranks fill the same range, so that all keep their share of MOST.
    near = near.orderBy(rank * F.col("n").cast("double"), "k", "l", "h").limit(MOST).select("k", "l", "h")
    # A table of at most MOST rows; repeated rows of the corpus count once.
    near = rows.join(F.broadcast(near), ["k", "l", "h"]).dropDuplicates(["k", "l", "h"])
    near = near.orderBy(rank, "k", "l", "h").select("l", "t")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed, names = [], []
            for name, value in zip(batch.column(0), batch.column(1)):
                out = np.zeros(1 << BITS, bool)
                if presence(value.as_py(), out):
                    packed.append(np.packbits(out).tobytes())
                    names.append(name.as_py())
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(packed, pa.binary())], ["l", "m"])

    # At most MOST rows of 2 ** BITS bits.
    found = near.mapInArrow(mark, "l string, m binary").toArrow()
    bits = [np.frombuffer(m, np.uint8) for m in found["m"].to_pylist()]
    marks = np.unpackbits(np.array(bits, np.uint8).reshape(-1, 1 << BITS >> 3), axis=1).astype(bool)
    return fit(marks, found["l"].to_pylist())


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """``(key, held_out, lang_pred, score)`` for each row of ``docs``.

    Learned from rows that are not held out and have a key, a text and a
    language. A null text, or one without a letter, or no rows to learn from:
    ``und`` with score 0. Ties go to the first language in order.
    """
    model = train(docs.where(~held_out(key)), key, text, lang)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        marks = np.zeros((BATCH, 1 << BITS), bool)
        for batch in batches:
            names, scores = [], []
            for at in range(0, batch.num_rows, BATCH):
                part = batch.column(1).slice(at, BATCH)
                marks[:] = False
                said = [presence(v.as_py(), row) for v, row in zip(part, marks)]
                if model is None or not any(said):
                    names += ["und"] * len(said)
                    scores += [0.0] * len(said)
                    continue
                found = model.scores(marks[: len(said)])
                best = found.argmax(1)
                names += [model.languages[b] if ok else "und" for b, ok in zip(best, said)]
                scores += [float(found[i, b]) if ok else 0.0 for i, (b, ok) in enumerate(zip(best, said))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["k", "lang_pred", "score"]
            )

    rows = docs.select(F.col(key).alias("k"), F.col(text).alias("t"))
    kind = rows.schema["k"].dataType.simpleString()
    scored = rows.mapInArrow(score, f"k {kind}, lang_pred string, score double")
    return scored.select(F.col("k").alias(key), held_out("k").alias("held_out"), "lang_pred", "score")
