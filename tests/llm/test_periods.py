import hashlib
import random
import time
import zlib

import numpy as np
import pytest

from palimpsest.llm import periods
from palimpsest.llm.periods import all_runs, periodic_runs, run_report, with_planted_repeats


def brute(words, least):
    """Lag by lag over all pairs; the smallest period of a stretch counts."""
    n, found = len(words), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, 2 * q):
                found.setdefault((s, i + q), q)
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def texts(rng):
    """Few letters, repeated and nested units, cut repeats, Fibonacci words."""
    n, kind = rng.randint(0, 160), rng.random()
    if kind < 0.3:
        return [rng.randint(0, 1) for _ in range(n)]
    if kind < 0.6:
        unit, out = [rng.randint(0, 2) for _ in range(rng.randint(1, 30))], []
        while len(out) < n:
            out += unit * rng.randint(1, 6) + [rng.randint(0, 2) for _ in range(rng.randint(0, 2))]
            if rng.random() < 0.4:
                unit = unit[: rng.randint(1, len(unit))]
            if rng.random() < 0.3:
                unit = unit + unit
        return out
    a, b = rng.choice([("a", "ab"), ("ab", "a"), ("aab", "ab"), ("a", "b")])
    while len(a) < n:
        a, b = (a + b, a) if rng.random() < 0.8 else (a * 2 + b, a)
    return [ord(c) for c in a[:n]]


@pytest.mark.parametrize("short", [4, 8, 16, 32])
def test_all_runs_against_brute_force(monkeypatch, short):
    monkeypatch.setattr(periods, "SHORT", short)
    least = 12 if short == 32 else short // 2
    rng = random.Random(short)
    for _ in range(250):
        w = texts(rng)
        several = [w, w[::-1], w[: len(w) // 2], []]
        got = all_runs([np.array(x, np.int64) for x in several], least)
        assert got == [brute(x, least) for x in several]


def test_runs_that_repeat_only_shorter_runs():
    w = [0, 1] * 300 + [0] + [0, 1] * 290 + [2] + [0, 1] * 40
    assert all_runs([np.array(w)], 12)[0] == brute(w, 12)


def test_planted_long_periods():
    rng = random.Random(5)
    for period in (13, 31, 32, 33, 63, 64, 100, 333, 777):
        unit = [rng.randint(0, 5000) for _ in range(period)]
        w = [rng.randint(0, 5000) for _ in range(50)] + (unit * 3)[: int(2.3 * period)] + [rng.randint(0, 5000) for _ in range(70)]
        got = all_runs([np.array(w)], 12)[0]
        assert got == brute(w, 12) and any(q == period for _, _, q in got)


def test_long_texts_cost_in_proportion():
    def seconds(n):
        begun = time.perf_counter()
        assert all_runs([np.full(n, 7)], 12)[0] == [(0, n, 1)]
        all_runs([np.random.default_rng(1).integers(0, 50, n)], 12)
        return time.perf_counter() - begun

    seconds(1000)
    assert seconds(800_000) < 12 * seconds(200_000) + 1


def test_rows_of_every_kind(spark):
    loop = "one two three " * 5
    rows = [
        (1, None, "x"), (2, "", "x"), (3, " \t\n\x0b\x0c\r", "x"), (4, loop, "x"), (4, loop, "y"), (None, loop, "x"),
        (5, "a b " * 12, "x"), (6, "wort " * 200_000, "x"), (7, "w" * 1_000_000, "x"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string").withColumnRenamed("runs", "collapsed")
    got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic_runs(df).collect()]
    looped = (15, [(0, 15, 3)], "one two three")
    assert sorted(got, key=repr) == sorted(
        [
            (1, 0, [], ""), (2, 0, [], ""), (3, 0, [], ""), (4, *looped), (4, *looped), (None, *looped),
            (5, 12, [(0, 12, 1)], "a b"), (6, 200_000, [(0, 200_000, 1)], "wort"), (7, 1, [], "w" * 1_000_000),
        ], key=repr)
    assert periodic_runs(df.limit(0)).count() == 0


def planted(doc_id, text):
    w = text.encode().split()
    h = zlib.crc32(str(doc_id).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    return w


def test_report_against_brute_force(spark):
    rng = random.Random(9)
    vocabulary = ["ab", "c", "Ü", "x.", "　y"]
    rows = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 90)))) for i in range(120)]
    rows += [(rng.randint(1000, 9999) * 10 + i % 10, "\n".join(f"w{rng.randint(0, 300)}" for _ in range(400))) for i in range(60)]
    df = spark.createDataFrame([*rows, (None, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in run_report(with_planted_repeats(df)).collect()}
    assert len(got) == len({r[0] for r in rows}) + 1
    for doc_id, text in dict(rows).items():
        w, r = planted(doc_id, text), got[doc_id]
        runs = brute(w, 12)
        kept = [x for i, x in enumerate(w) if not any(s + q <= i < s + n for s, n, q in runs)]
        said = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
        assert r.n_runs == len(runs)
        assert r.runs_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(b" ".join(kept)).hexdigest()
        if runs:
            s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]))
            assert (r.start, r.length, r.period, r.exponent_milli) == (s, n, q, 1000 * n // q)
        else:
            assert (r.start, r.length, r.period, r.exponent_milli) == (None,) * 4
