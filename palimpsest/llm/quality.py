"""Quality classifier: a sparse ensemble of rules.

Statistics of each whole text feed small boosted trees. The path to each tree
node is a rule, a conjunction of thresholds; a logistic model with an L1
penalty over all rules keeps a few of them. Those become one Spark column
expression, so scoring is a projection.

Fitting uses at most ``sample`` labelled rows, the ones whose key hashes
lowest, on the driver; everything else covers all rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce
from operator import and_, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STATISTICS = (
    "chars", "words", "lines", "word_length", "line_words", "upper", "digit", "space", "sentence",
    "symbol", "pipe", "bang", "distinct", "same_next", "line_repeat", "decorated",
)
# Statistics and the text stand beside other columns of any name.
_PREFIX = "__statistic_"
SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
LAMBDA, STEPS = 0.002, 600

_MARKS = np.zeros(256, bool)
_MARKS[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,'-|!\"?:;()"]] = True
_DECOR = tuple(bytes([b]) for b in np.flatnonzero(_MARKS)) + (b"!!",)


def statistics_of(text: str | None) -> tuple[float, ...]:
    """The statistics of one whole text; null and empty give zeros."""
    data = (text or "").encode("utf-8", "replace")
    seen = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words, lines = data.split(), [x for x in data.split(b"\n") if x.strip()]
    n, w, m = max(len(data), 1), max(len(words), 1), max(len(lines), 1)
    letters = max(int(seen[65:91].sum() + seen[97:123].sum() + seen[128:].sum()), 1)
    return (
        float(len(data)),
        float(len(words)),
        float(len(lines)),
        (n - int(seen[[9, 10, 13, 32]].sum())) / w,
        len(words) / m,
        seen[65:91].sum() / letters,
        seen[48:58].sum() / n,
        seen[[9, 10, 13, 32]].sum() / n,
        seen[[46, 63]].sum() / w,
        seen[_MARKS].sum() / n,
        seen[124] / w,
        seen[33] / w,
        len(set(words)) / w,
        sum(map(eq, words, words[1:])) / w,
        1 - len(set(lines)) / m,
        sum(x.endswith(_DECOR) for x in words) / w,
    )


def with_statistics(docs: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """``columns`` of ``docs`` and the statistics, named with a prefix."""
    names = [f"{_PREFIX}{s}" for s in STATISTICS]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [statistics_of(v.as_py()) for v in batch.column(batch.num_columns - 1)]
            table = np.array(found, np.float64).reshape(-1, len(names))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c) for c in table.T)], [*batch.schema.names[:-1], *names]
            )

    kept = docs.select(*columns, F.col(text).alias("__whole_text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields[:-1])
    return kept.mapInArrow(measure, f"{kinds}, " + ", ".join(f"{n} double" for n in names))


@dataclass(frozen=True)
class Rule:
    """All of ``(statistic number, threshold, above)``; ``above`` means ``> threshold``."""

    parts: tuple[tuple[int, float, bool], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        return reduce(and_, [(x[:, i] > t) == above for i, t, above in self.parts])

    def column(self) -> Column:
        tests = (F.col(f"{_PREFIX}{STATISTICS[i]}") > t for i, t, _ in self.parts)
        return reduce(and_, [c if above else ~c for c, (_, _, above) in zip(tests, self.parts)])


@dataclass(frozen=True)
class RuleModel:
    bias: float
    rules: tuple[tuple[Rule, float], ...]

    def predict(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        for rule, weight in self.rules:
            total += weight * rule.holds(x)
        return 1 / (1 + np.exp(-total))

    def column(self) -> Column:
        """The score as an expression over the statistics."""
        total = F.lit(float(self.bias))
        for rule, weight in self.rules:
            total = total + F.when(rule.column(), F.lit(float(weight))).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def _grow(codes, cuts, gradient, hessian, rows, depth, path, rules, out) -> None:
    """One node of a boosted tree: best split by gain over binned statistics."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-6, None, None)
    if depth:
        for i, edge in enumerate(cuts):
            if len(edge):
                left_g = np.bincount(codes[rows, i], gradient[rows], len(edge) + 1).cumsum()[:-1]
                left_h = np.bincount(codes[rows, i], hessian[rows], len(edge) + 1).cumsum()[:-1]
                ok = (left_h > 2) & (h - left_h > 2)
                gain = np.where(
                    ok, left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g * g / (h + 1), 0
                )
                if gain.max() > best[0]:
                    best = (gain.max(), i, int(gain.argmax()))
    if best[1] is None:
        out[rows] = -g / (h + 1)
        return
    _, i, at = best
    for above in (False, True):
        side = rows[(codes[rows, i] > at) == above]
        step = (*path, (i, float(cuts[i][at]), above))
        rules.add(Rule(tuple(sorted(step))))
        _grow(codes, cuts, gradient, hessian, side, depth - 1, step, rules, out)


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """Trees, their paths as rules, and lasso logistic weights over the rules.

    One class only, or no rows: a constant, with a half a row of either class added.
    """
    prior = (y.sum() + 0.5) / (len(y) + 1)
    bias = float(np.log(prior / (1 - prior)))
    if not len(y) or y.min() == y.max():
        return RuleModel(bias, ())
    cuts = [np.unique(np.quantile(c, np.linspace(0.01, 0.99, BINS))) for c in x.T]
    # Code c holds what is above cut c - 1 and at most cut c.
    codes = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(cuts, x.T)], 1)
    total, rules = np.full(len(y), bias), set()
    for _ in range(TREES):
        p, out = 1 / (1 + np.exp(-total)), np.zeros(len(y))
        _grow(codes, cuts, p - y, p * (1 - p), np.arange(len(y)), DEPTH, (), rules, out)
        total += RATE * out
    if not rules:
        # Too few rows for any split.
        return RuleModel(bias, ())
    ordered = sorted(rules, key=lambda r: r.parts)
    z = np.stack([r.holds(x) for r in ordered], 1).astype(np.float64)
    # Accelerated proximal gradient; the bias is not penalised.
    step = 4 * len(y) / (np.linalg.norm(np.c_[z, np.ones(len(y))], 2) ** 2 + 1e-9)
    w = v = np.zeros(z.shape[1] + 1)
    w[-1] = bias
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(z @ v[:-1] + v[-1])))
        new = v - step * np.r_[z.T @ (p - y), (p - y).sum()] / len(y)
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - step * LAMBDA, 0)
        s = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v, w, t = new + (t - 1) / s * (new - w), new, s
    kept = tuple((r, float(c)) for r, c in zip(ordered, w) if c)
    return RuleModel(float(w[-1]), kept)


def train(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, sample: int = SAMPLE) -> RuleModel:
    """Fit on the ``sample`` labelled keys that hash lowest; null labels and texts are no rows."""
    marked = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    marked = marked.groupBy(key).agg(F.max(label).cast("int").alias("_label"))
    chosen = marked.orderBy(F.xxhash64(key), key).limit(sample)
    # At most ``sample`` rows of two numbers: small by construction.
    rows = docs.select(key, text).join(F.broadcast(chosen), key).where(F.col(text).isNotNull())
    table = with_statistics(rows, [key, "_label"], text).orderBy(key).toArrow().to_pandas()
    x = table[[f"{_PREFIX}{s}" for s in STATISTICS]].to_numpy(np.float64).reshape(-1, len(STATISTICS))
    return fit(x, table["_label"].to_numpy(np.float64))


def held_out(key: str) -> Column:
    """Rows kept from training: the key's crc32 has no remainder by five. Null keys are."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % 5 == 0, F.lit(True))


def score_quality(
    docs: DataFrame, model: RuleModel, keep: Sequence[str], text: str = "text", out: str = "score"
) -> DataFrame:
    """``keep`` and the score ``out`` for each row; null and empty texts are scored as empty."""
    return with_statistics(docs, keep, text).select(*keep, model.column().alias(out))


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, held_out, score, predicted)`` for each row of ``docs``.

    Only rows that are not held out, joined with their label, are learned from.
    Repeated rows come back repeated; without labels all scores are one half.
    """
    model = train(docs, labels.where(~held_out(key)), key, text, "quality")
    scored = score_quality(docs, model, [key], text)
    return scored.select(
        key, held_out(key).alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted")
    )
