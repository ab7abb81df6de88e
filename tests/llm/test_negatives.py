import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from palimpsest.llm import negatives
from palimpsest.llm.negatives import build_tree, hard_negatives, scaled, search_tree

SCHEMA = "vec_id long, label int, embedding array<double>, id string, x int, anchor int"


def clamp(v):
    return min(max(v, -(2**63)), 2**63 - 1)


def brute(rows, every, positives=5, negs=10, low=30, high=90):
    """All pairs, in whole numbers of any size."""
    width = max((len(v) for _, _, v in rows if v is not None), default=0)

    def fit(i, label, v):
        return i is not None and label is not None and v is not None and all(c is not None and np.isfinite(c) for c in v)

    kept = [(i, label, [int(c) for c in v] + [0] * (width - len(v))) for i, label, v in rows if fit(i, label, v)]
    score = lambda a, b: clamp(sum(p * q for p, q in zip(a, b)))
    out = set()
    anchors = {}
    for i, label, v in sorted((r for r in kept if r[0] % every == 0), key=lambda r: (r[1], r[2]), reverse=True):
        anchors[i] = (label, v)
    for a, (label, v) in anchors.items():
        said = sorted((-score(v, w), i) for i, m, w in kept if m == label and i != a)[:positives]
        others = sorted((-score(v, w), i) for i, m, w in kept if m != label)
        for n, (s, p) in enumerate(said):
            fits = [(-t, i) for t, i in others if low * -s <= 100 * -t <= high * -s][:negs]
            out |= {(n, a, p, r + 1, i, -s, t) for r, (t, i) in enumerate(fits)}
    return out


def answer(df, every):
    got = [tuple(r) for r in hard_negatives(df, F.col("vec_id") % every == 0).collect()]
    return got, {r for r in got}


def clustered(rng, n, width, labels):
    centers = rng.normal(size=(6, width)) * 200
    x = np.floor(centers[rng.integers(0, 6, n)] + rng.normal(size=(n, width)) * rng.choice([0, 5, 60], (n, 1)))
    return [(i, int(rng.integers(0, labels)), v.tolist()) for i, v in enumerate(x)]


@pytest.mark.parametrize("width, labels", [(2, 3), (8, 2), (24, 5)])
def test_against_brute_force(spark, monkeypatch, width, labels):
    monkeypatch.setattr(negatives, "TREE", 64)
    monkeypatch.setattr(negatives, "BLOCK", 16)
    rows = clustered(np.random.default_rng(width), 900, width, labels)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA).repartition(5)
    got, distinct = answer(df, 9)
    assert len(got) == len(distinct)
    assert distinct == {r[1:] for r in brute(rows, 9)}


def test_rows_of_every_kind(spark):
    rng = random.Random(4)
    vectors = [[rng.randint(-9, 9) * 1.0 for _ in range(4)] for _ in range(12)]
    rows = [(i, i % 3, rng.choice(vectors)) for i in range(80)]
    rows += [(None, 1, vectors[0]), (3, None, vectors[0]), (5, 1, None), (10, 1, [1.0, None, 2.0, 0.0]), (20, 2, [])]
    rows += [(30, 2, [float("nan")] * 4), (40, 2, [float("inf")] * 4), (50, 2, [7.0]), (50, 2, [8.0, 1.0])]
    rows += [(60, 0, vectors[1])] * 3 + [(61, 1, vectors[1])] * 30
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got, distinct = answer(df, 10)
    assert distinct == {r[1:] for r in brute(rows, 10)}
    # Repeated rows are candidates of their own.
    assert len(got) == len(brute(rows, 10))
    assert answer(df.limit(0), 10) == ([], set())
    assert answer(df.where("label = 1"), 10) == ([], set())


def test_scores_beyond_doubles_are_exact(spark):
    rng = random.Random(8)
    rows = [(i, i % 2, [float(rng.randint(1, 2**31)) for _ in range(3)]) for i in range(60)]
    rows += [(100 + i, i % 2, [float(2**40 * rng.randint(1, 9))] * 3) for i in range(10)]
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    assert answer(df, 10)[1] == {r[1:] for r in brute(rows, 10)}


def test_tree_levels_cover_and_prune():
    rng = np.random.default_rng(2)
    x = np.floor(np.repeat(rng.normal(size=(40, 16)) * 300, 40, axis=0) + rng.normal(size=(1600, 16)) * 8)
    order, norm, starts, levels = build_tree(x)
    assert len(levels) > 2 and starts[-1] == len(x) and sorted(order) == list(range(len(x)))
    for level in levels:
        assert len(level["centers"]) * negatives.LEAST_LEAF <= len(x)
    for upper, lower in zip(levels, levels[1:]):
        assert set(upper["centers"]) <= set(lower["centers"])
    places = np.argsort(order)
    for level in levels:
        level["centers"] = places[level["centers"]]
        level["parents"], level["radii"] = np.array(level["parents"]), np.array(level["radii"])
    scored = []
    tree = {"x": x[order], "ids": order, "labels": np.zeros(len(x), int), "norm": norm, "starts": starts, "levels": levels}
    plain = negatives._scores
    try:
        negatives._scores = lambda *a: scored.append(len(a[0])) or plain(*a)
        rows = search_tree(tree, x[:1], True, [0], [0], [[(0, -(2**63), 2**63 - 1)]], 5)
    finally:
        negatives._scores = plain
    want = sorted((-int(s), i) for i, s in enumerate(x @ x[0]) if i)[:5]
    assert [(s, i) for _, _, s, i in rows] == [(-s, i) for s, i in want]
    assert sum(scored) < len(x) / 4


def test_scaled_rounds_down(spark):
    df = spark.createDataFrame([([0.5, -0.001, 1e300, None, -2.0],), (None,)], "embedding array<double>")
    got = [r[0] for r in scaled(df).collect()]
    assert got == [[128.0, -1.0, 256e300, None, -512.0], None]
