import random

from pyspark.sql import functions as F

from palimpsest.operators.detect import detect
from palimpsest.operators.glossary import detect_literals_large
from palimpsest.operators.ruleset import Ruleset, Term
from tests import reader

TERMS = "term_ord long, term string, ty string, priority int, tenant string"


def found(df, terms, **kw):
    return {r.id: [(s.start, s.end, s.ty) for s in r.spans] for r in detect_literals_large(df, terms, ["id"], **kw).collect()}


def test_terms_of_every_length_against_brute_force(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("ab é😀") for _ in range(n))
    terms = sorted({word(rng.choice([1, 2, 3, 4, 7, 8, 9, 15, 16, 17, 40, 90, 200])) for _ in range(120)})
    texts = [word(300) + rng.choice(terms) + word(20) + rng.choice(terms) for _ in range(40)] + ["", None, terms[-1]]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "xx" + terms[0])], "id int, text string")
    table = spark.createDataFrame([(i, t, "T", 1, None) for i, t in enumerate(terms)], TERMS)
    for limit in (0, 1 << 20):
        got = found(df, table, limit=limit)
        for i, t in [*enumerate(texts), (None, "xx" + terms[0])]:
            assert [(s, e) for s, e, _ in got[i]] == reader.literals(t or "", terms)
    assert found(df, table.limit(0)) == {i: [] for i in got}


def test_terms_of_other_tenants_meet_nothing(spark):
    rows = [(i, f"secret{j}value", "T", 1, f"t{i % 5}") for i, j in enumerate(range(500))]
    terms = spark.createDataFrame([*rows, (900, "shared words", "S", 1, None)], TERMS)
    text = " ".join(f"secret{j}value" for j in range(500)) + " shared words"
    df = spark.createDataFrame([(i, f"t{i}" if i < 5 else None, text) for i in range(6)], "id int, who string, text string")
    got = found(df, terms, tenant="who")
    assert [len(got[i]) for i in range(6)] == [101] * 5 + [1]


def test_the_first_listed_wins(spark):
    df = spark.createDataFrame([(1, "a word here")], "id int, text string")
    for order in ((4, 5), (5, 4), (-(2**62), 2**62)):
        terms = spark.createDataFrame([(order[0], "word", "ZZ", 1, None), (order[1], "word", "AA", 1, None)], TERMS)
        want = "ZZ" if order[0] < order[1] else "AA"
        got = detect(df, Ruleset(), glossary=terms, key=["id"]).first().spans
        assert [s.ty for s in got] == [want]
        own = detect(df, Ruleset(terms=(Term("word", "OWN", 1),)), glossary=terms, key=["id"]).first().spans
        assert [s.ty for s in own] == ["OWN"]


def test_a_word_in_every_text_stays_one_row_per_place(spark):
    df = spark.range(2000).select(F.col("id").cast("int"), F.lit("the and the").alias("text"))
    got = found(df, spark.createDataFrame([(0, "the", "T", 1, None), (1, "the end", "E", 1, None)], TERMS), limit=0)
    assert len(got) == 2000 and all(v == [(0, 3, "T"), (8, 11, "T")] for v in got.values())
