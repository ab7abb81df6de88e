import json
import random

import pandas as pd
from pyspark.sql import functions as F

from palimpsest.operators.jsonpaths import (
    extract_leaves, leaves, mask_json, mask_json_session, mask_json_typed, typed_leaves,
)
from palimpsest.operators.rehydrate import rehydrate
from palimpsest.operators.ruleset import Rule, Ruleset, Term
from palimpsest.plans.stage import stage
from tests import reader

SECRET = "5a" * 32
EMAIL = Ruleset((Rule("email", "EMAIL", r"[\w.]+@[\w.]+", 50),))
NUL = "\0"


def tree(rng, depth=0):
    """A random JSON value with addresses, escapes and odd keys."""
    kind = rng.random()
    if depth > 4 or kind < 0.45:
        odd = rng.choice(["", '"', "\\", "\n", "\\u0041", "é😀", "#3", NUL, "a: b", '":"'])
        return rng.choice(["x", f"to u{rng.randint(0, 4)}@a.b" + odd, odd, odd + "z"])
    if kind < 0.55:
        return rng.choice([1, -2.5, True, None, 10**17, "#0"])
    if kind < 0.75:
        return [tree(rng, depth + 1) for _ in range(rng.randint(0, 4))]
    keys = rng.sample(["a", "b", 'k"', "k\\", "#1", "a.b", "z z", "é", ":", ""], rng.randint(0, 4))
    return {k: tree(rng, depth + 1) for k in keys}


def texts(value, path="", steps=()):
    if isinstance(value, str):
        yield path, list(steps), value
    elif isinstance(value, list):
        for i, x in enumerate(value):
            yield from texts(x, f"{path}[{i}]", (*steps, str(i)))
    elif isinstance(value, dict):
        for k in sorted(value):
            yield from texts(value[k], f"{path}.{k}" if path else k, (*steps, k))


def put(value, change):
    if isinstance(value, str):
        return change(value)
    if isinstance(value, list):
        return [put(x, change) for x in value]
    if isinstance(value, dict):
        return {k: put(value[k], change) for k in sorted(value)}
    return value


def frame(spark, bodies):
    return spark.createDataFrame(list(enumerate(bodies)), "id int, body string")


def test_every_leaf_and_back_against_a_parser(spark):
    rng = random.Random(2)
    values = [tree(rng) for _ in range(300)]
    bodies = [json.dumps(v, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])) for v in values]
    df = frame(spark, bodies)
    got = df.select("id", leaves(F.col("body"), ["**"]).alias("l")).collect()
    for r in got:
        assert [tuple(x) for x in r.l] == [tuple(x) for x in texts(values[r.id])]
    import re

    for r in mask_json(df, EMAIL, SECRET, "id").collect():
        seen: dict = {}
        for _, _, t in texts(values[r.id]):
            for m in re.findall(r"[\w.]+@[\w.]+", t):
                seen.setdefault(m, len(seen))
        key = reader.scope_key(SECRET, str(r.id))
        mark = lambda m, key=key, seen=seen: reader.sentinel("EMAIL", seen[m[0]], reader.tag(key, seen[m[0]]))
        want = put(values[r.id], lambda t, mark=mark: re.sub(r"[\w.]+@[\w.]+", mark, t))
        assert json.loads(r.masked_body) == want
        assert [(e.id, e.original) for e in r.entries] == [(i, m) for m, i in seen.items()]


def test_what_a_strict_reader_refuses_gives_null(spark):
    bad = [
        '{"a":"one a@b.com","a":"two","n":1}', '{"a":"a@b.com","n":1e400}', '{"a":"a@b.com","m":NaN}', '{"a":"x\\ud800y a@b.com"}',
        '{"a":"x\\udc00 a@b.com"}', '{"a":"a@b.com\\x"}', '{"a":"a@b.com\ttab"}', '{"a":"a@b.com"', '{"a":"a@b.com\x01"}',
        '{"a":"a@b.com"} x', "a@b.com", '{"a":-Infinity,"b":"a@b.com"}', '"a@b.com', '{"\\u0061":"a@b.com","a":"q"}', '{"a":"a@b.com\\u12"}',
    ]
    df = frame(spark, [*bad, None, "", '{"a":1e30}', '"\\ud83d\\ude00 a@b.com"', '"\\\\ud800 a@b.com"'])
    got = {r.id: r for r in mask_json(df, EMAIL, SECRET, "id").collect()}
    assert all(got[i].masked_body is None and got[i].report.total == 0 for i in range(len(bad)))
    n = len(bad)
    assert [got[n + i].masked_body for i in range(3)] == [None, "", '{"a":1e30}']
    assert "@" not in got[n + 3].masked_body + got[n + 4].masked_body
    assert json.loads(got[n + 3].masked_body).startswith("😀") and json.loads(got[n + 4].masked_body).startswith("\\ud800")
    plain = {r.id: r.masked_body for r in mask_json(df, EMAIL, SECRET, "id", enforce=False).collect()}
    assert plain[0] == bad[0]


def test_null_scope_does_not_end_the_job(spark):
    df = spark.createDataFrame([(1, None, '{"a":"x@y.z"}'), (2, "s", '{"a":"x@y.z"}')], "id int, who string, body string")
    for r in mask_json(df, EMAIL, SECRET, "who").collect():
        assert "@" not in r.masked_body and len(r.entries) == 1


def test_no_python_in_the_plan(spark):
    df = frame(spark, ['{"a":"x@y.z"}'])
    plan = mask_json(df, EMAIL, SECRET, "id")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


def chats(spark):
    rows = [
        ("s1", 0, {"m": [{"c": "b@x.y and a@x.y"}, {"c": "a@x.y"}], "a": "z@x.y"}),
        ("s1", 1, {"m": [{"c": "new@x.y z@x.y"}], "a": "none"}),
        ("s2", 0, {"m": [{"c": "z@x.y"}], "a": "none"}),
        (None, 0, {"m": [{"c": "z@x.y"}], "a": "q@x.y"}),
        (None, 1, {"m": [{"c": "q@x.y"}]}),
        ("s2", 1, {"m": "nothing"}),
    ]
    return spark.createDataFrame([(i, s, t, json.dumps(b)) for i, (s, t, b) in enumerate(rows)] + [(9, "s2", 2, "{bad a@b.c")],
                                 "id int, sess string, turn int, body string")


def test_session_bodies_share_a_vault(spark):
    df = chats(spark)
    for keep in (None, stage):
        masked, entries = mask_json_session(df, EMAIL, SECRET, ["id"], "sess", ["turn"], stage=keep)
        got = {r.id: r for r in masked.collect()}
        ids = {(r.scope_key, r.original): r.id for r in entries.collect()}
        # Object keys come in order: "a" before "m".
        first = {"z@x.y": 0, "b@x.y": 1, "a@x.y": 2, "new@x.y": 3}
        assert {o: i for (s, o), i in ids.items() if s == "s1"} == first
        assert {o: i for (s, o), i in ids.items() if s == "s2"} == {"z@x.y": 0}
        own = {(s, o): i for (s, o), i in ids.items() if s not in ("s1", "s2")}
        assert sorted(own.values()) == [0, 0, 1] and len({s for s, _ in own}) == 2
        key = reader.scope_key(SECRET, "s1")
        mark = lambda n: reader.sentinel("EMAIL", n, reader.tag(key, n))  # noqa: E731, B023
        assert json.loads(got[0].masked_body) == {"a": mark(0), "m": [{"c": f"{mark(1)} and {mark(2)}"}, {"c": mark(2)}]}
        assert json.loads(got[1].masked_body) == {"a": "none", "m": [{"c": f"{mark(3)} {mark(0)}"}]}
        assert got[5].masked_body == df.where("id = 5").first().body and got[9].masked_body is None
        assert not any("@" in r.masked_body for r in got.values() if r.masked_body)
        assert masked.columns == [*df.columns, "masked_body", "report"]


def test_session_bodies_come_back(spark):
    df = chats(spark).where("id <> 9")
    masked, entries = mask_json_session(df, EMAIL, SECRET, ["id"], "sess", ["turn"], stage=stage)
    back = rehydrate(masked.select("id", "sess", F.col("masked_body").alias("masked")), entries, SECRET, ["id"], "sess", encoding="json")
    want = {r.id: json.loads(r.body) for r in df.collect()}
    assert {r.id: json.loads(r.rehydrated) for r in back.collect()} == want


def test_any_number_of_terms_tenants_and_detectors(spark):
    terms = tuple(Term(f"term{i}x", "T", 5, "acme" if i % 2 else None) for i in range(700))
    rows = [(i, t, json.dumps({"b": f"say term{i}x, term1x!", "a": ["term2x", "hit me"]})) for i, t in enumerate(["acme", None, "other", "acme"])]
    df = spark.createDataFrame(rows, "id int, tenant string, body string")

    @F.pandas_udf("array<struct<start:int,end:int,ty:string,priority:int>>")
    def hits(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [{"start": t.index("hit"), "end": t.index("hit") + 3, "ty": "HIT", "priority": 1}] if "hit" in t else [])

    def want(i, tenant):
        seen = ["term2x", "hit"]
        for t in (f"term{i}x", "term1x"):
            if t not in seen and (int(t[4:-1]) % 2 == 0 or tenant == "acme"):
                seen.append(t)
        return seen

    for rules in (Ruleset(terms=terms), Ruleset(terms=terms[:10])):
        got = mask_json(df, rules, SECRET, "id", tenant="tenant", custom=[hits], key=["id"]).collect()
        assert {r.id: [e.original for e in r.entries] for r in got} == {r.id: want(r.id, r.tenant) for r in got}
        masked, vault = mask_json_session(df, rules, SECRET, ["id"], "tenant", ["id"], tenant="tenant", custom=[hits], stage=stage)
        kept = vault.groupBy("scope_key").agg(F.collect_set("original").alias("o")).collect()
        assert {r.scope_key: set(r.o) for r in kept}["acme"] == set(want(0, "acme")) | set(want(3, "acme"))
        assert all("term2x" not in r.masked_body and "hit" not in r.masked_body for r in masked.collect())


def test_typed_columns_keep_their_type(spark):
    kind = (
        "z string, a array<struct<b:string,c:array<string>,n:int>>, m map<string,struct<t:string>>, k map<int,string>, v varchar(30),"
        " e struct<>, d array<array<string>>, ts timestamp"
    )
    rows = [
        (1, ("z a@b.c", [("b@b.c", ["x", None, "a@b.c"], 3), None, (None, None, 4), ("q@q.q", [], 5)], {"y": ("y@y.y",), "x": None, "a": ("a@b.c",)},
             {1: "no@tou.ch"}, "v@v.v", (), [["d@d.d"], None, [], ["z", "e@e.e"]], None)),
        (2, None), (3, (None,) * 8), (4, ("plain", [], {}, {}, "p", (), [], None)),
    ]
    df = spark.createDataFrame(rows, f"id int, body struct<{kind.replace(' string', ':string').replace('z:string', 'z:string')}>" if False else
                               "id int, body struct<z:string,a:array<struct<b:string,c:array<string>,n:int>>,m:map<string,struct<t:string>>,"
                               "k:map<int,string>,v:string,e:struct<>,d:array<array<string>>,ts:timestamp>")  # fmt: skip
    done = mask_json_typed(df, EMAIL, SECRET, "id")
    assert done.schema["masked_body"].dataType == df.schema["body"].dataType
    got = {r.id: r for r in done.collect()}
    order = ["b@b.c", "a@b.c", "q@q.q", "d@d.d", "e@e.e", "y@y.y", "v@v.v"]
    assert [e.original for e in got[1].entries] == order
    key = reader.scope_key(SECRET, "1")
    mark = {o: reader.sentinel("EMAIL", i, reader.tag(key, i)) for i, o in enumerate(order)}
    b = got[1].masked_body
    assert b.z == f"z {mark['a@b.c']}" and b.v == mark["v@v.v"] and b.k == {1: "no@tou.ch"}
    assert [x and (x.b, x.c, x.n) for x in b.a] == [
        (mark["b@b.c"], ["x", None, mark["a@b.c"]], 3), None, (None, None, 4), (mark["q@q.q"], [], 5)]
    assert {k: v and v.t for k, v in b.m.items()} == {"y": mark["y@y.y"], "x": None, "a": mark["a@b.c"]}
    assert b.d == [[mark["d@d.d"]], None, [], ["z", mark["e@e.e"]]]
    assert got[2].masked_body is None and got[3].masked_body.z is None and got[4].masked_body.z == "plain"


def test_typed_agrees_with_text(spark):
    df = frame(spark, ['{"a":[{"b":"x","c":null},{"b":"y","c":["p","q"]}],"z":"w"}'])
    typed = df.withColumn("t", F.from_json("body", "a array<struct<b:string,c:array<string>>>, z string"))
    got = typed.select(typed_leaves(F.col("t"), typed.schema["t"].dataType), leaves(F.col("body"), ["**"])).first()
    assert [tuple(x) for x in got[0]] == [tuple(x) for x in got[1]]


def test_many_leaves_and_long_texts_cost_in_proportion(spark):
    import time

    def seconds(n):
        body = json.dumps({"a": [{"c": f"u{i}@x.y"} for i in range(n)], "long": "word a@b.c " * n})
        df = frame(spark, [body])
        begun = time.perf_counter()
        r = mask_json(df, EMAIL, SECRET, "id").first()
        assert "@" not in r.masked_body and len(r.entries) == n + 1
        return time.perf_counter() - begun

    seconds(10)
    assert seconds(16_000) < 8 * seconds(4_000) + 2
    assert extract_leaves(frame(spark, ["[" * 900 + '"x"' + "]" * 900]), ["id"], "body", ["**"]).count() == 1
