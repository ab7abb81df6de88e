import random

import pytest
from pyspark.sql import functions as F

from palimpsest.operators.keyed import number_rows, ranged
from palimpsest.operators.vault import sessionize


def hot_rows(spark, n=6000):
    """One group holds two thirds of the rows, its first order column is constant; another group has no name."""
    rng = random.Random(6)
    rows = [("hot", 7, i, {"k": i}) for i in range(2 * n // 3)]
    rows += [(None, rng.randint(0, 2), i, None) for i in range(n // 6)] + [(f"g{i % 50}", i % 3, i, {}) for i in range(n // 6)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, o bigint, u bigint, m map<string,bigint>").repartition(6)


def test_no_range_holds_more_than_the_target(spark):
    rows, df = hot_rows(spark)
    sizes = ranged(df, ["g"], ["o", "u"], target=500).groupBy("_part").count().collect()
    assert max(r["count"] for r in sizes) <= 500 and sum(r["count"] for r in sizes) == len(rows)
    # Even where group and order say nothing, the other columns tell rows apart.
    flat = ranged(df.withColumn("g", F.lit("x")), ["g"], ["o"], target=500).groupBy("_part").count()
    assert flat.agg(F.max("count")).first()[0] <= 500


@pytest.mark.parametrize("target", [500, 100_000])
def test_numbers_of_hot_groups(spark, target):
    rows, df = hot_rows(spark)
    base = spark.createDataFrame([("hot", 10), (None, 5)], "g string, start bigint")
    done = number_rows(df, ["g"], ["o", "u"], base, "p", target)
    assert done.columns == ["g", "o", "u", "m", "p"]
    got = {(r.g, r.o, r.u): r.p for r in done.collect()}
    want = {}
    for g in {r[0] for r in rows}:
        for p, r in enumerate(sorted(r[:3] for r in rows if r[0] == g) if g else sorted((r[:3] for r in rows if r[0] is None), key=lambda r: r[1:])):
            want[r] = p + {"hot": 10, None: 5}.get(g, 0)
    assert got == want
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_hot_sessions(spark):
    rng = random.Random(1)
    rows, at = [], 0
    for i in range(3000):
        at += rng.choice([1, 5, 30, 59, 60, 61, 4000])
        rows.append(("hot", at, i))
    rows += [(None, 100 * i, i) for i in range(400)] + [(f"s{i % 9}", 55 * i, i) for i in range(300)] + [("hot", None, 9999), ("s1", None, 1)]
    df = spark.createDataFrame(rows, "s string, t bigint, n int").withColumn("ts", F.timestamp_seconds("t")).repartition(5)
    want = {}
    for s in {r[0] for r in rows}:
        last, generation = None, 0
        for _, t, n in sorted((r for r in rows if r[0] == s), key=lambda r: (r[1] is not None, r[1] or 0)):
            if last is not None and t is not None and t - last >= 60:
                generation += 1
            last = t if t is not None else last
            want[s, n, t] = generation
    for target in (200, 10**6):
        got = {(r.s, r.n, r.t): r.generation for r in sessionize(df, ["s"], "ts", 60, target=target).collect()}
        assert got == want
