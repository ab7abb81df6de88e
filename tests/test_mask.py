import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions import mac_pads, scope_key_hex
from palimpsest.operators.detect import detect
from palimpsest.operators.keyed import lookup, number_rows
from palimpsest.operators.mask import mask_request, mask_session
from palimpsest.operators.rehydrate import (
    audit_sentinels,
    join_chunks,
    parse_sentinels,
    rehydrate,
    rehydrate_inline,
    segments,
)
from palimpsest.operators.ruleset import Rule, Ruleset, Term
from palimpsest.operators.vault import (
    dedup_vault,
    first_seen,
    intern_session,
    intern_sharded,
    merge_vault,
    namespace,
    seal,
    sessionize,
    unseal,
)
from palimpsest.plans.stage import stage
from palimpsest.sources.vault_store import commit_batch, read_vault, unsealable
from tests import reader

SECRET = "5a" * 32
RULES = Ruleset(
    (Rule("email", "EMAIL", r"[\w.]+@[\w.]+", 50),), (Term("Project Hufflepuff", "CODENAME", 100),)
)
VAULT = "scope_key string, id bigint, original string, ty string, first_seen bigint, uses bigint"


def test_request_scope(spark):
    text = "email john@acme.com about Project Hufflepuff, cc john@acme.com"
    df = spark.createDataFrame([("r1", text), ("r2", "nothing")], "k string, text string")
    rows = mask_request(df, RULES, SECRET, "k").orderBy("k").collect()
    key = reader.scope_key(SECRET, "r1")
    mail, code = (reader.sentinel(t, n, reader.tag(key, n)) for t, n in (("EMAIL", 0), ("CODENAME", 1)))
    assert rows[0]["masked"] == f"email {mail} about {code}, cc {mail}"
    assert [(e["id"], e["original"]) for e in rows[0]["entries"]] == [(0, "john@acme.com"), (1, "Project Hufflepuff")]
    assert rows[0]["report"]["summary"] == "CODENAME=1,EMAIL=2" and rows[0]["report"]["total"] == 3
    assert rows[1]["masked"] == "nothing" and rows[1]["report"]["summary"] == ""
    bare = mask_request(df, RULES, SECRET, "k", style="bare-sentinel").orderBy("k").first()["masked"]
    assert bare == rows[0]["masked"].replace(":EMAIL", "").replace(":CODENAME", "")
    back = mask_request(df, RULES, SECRET, "k").select(
        "text", rehydrate_inline(F.col("masked"), F.col("entries"), mac_pads(scope_key_hex(SECRET, F.col("k")))).alias("b")
    )
    assert all(r["text"] == r["b"] for r in back.collect())


TURNS = [
    ("A", 1, "ping alice@x.com"),
    ("A", 2, "new bob@y.com old alice@x.com"),
    ("B", 1, "only alice@x.com"),
    ("B", 2, "quiet"),
]


@pytest.mark.parametrize("staged", [None, stage])
@pytest.mark.parametrize("target", [1, 1000])
def test_session_scope(spark, staged, target):
    df = spark.createDataFrame(TURNS, "s string, turn int, text string")
    masked, new = mask_session(
        detect(df, RULES), SECRET, ["s", "turn"], "s", ["turn"], stage=staged, target=target
    )
    got = {(r["scope_key"], r["original"]): r["id"] for r in new.collect()}
    assert got == {("A", "alice@x.com"): 0, ("A", "bob@y.com"): 1, ("B", "alice@x.com"): 0}
    tag = lambda s, n: reader.sentinel("EMAIL", n, reader.tag(reader.scope_key(SECRET, s), n))
    want = {("A", 1): f"ping {tag('A', 0)}", ("A", 2): f"new {tag('A', 1)} old {tag('A', 0)}",
            ("B", 1): f"only {tag('B', 0)}", ("B", 2): "quiet"}
    assert {(r["s"], r["turn"]): r["masked"] for r in masked.collect()} == want
    # A later job continues from the vault.
    later = spark.createDataFrame([("A", 3, "bob@y.com zed@z.org")], "s string, turn int, text string")
    masked2, new2 = mask_session(
        detect(later, RULES), SECRET, ["s", "turn"], "s", ["turn"], vault=new, stage=staged, target=target
    )
    assert masked2.first()["masked"] == f"{tag('A', 1)} {tag('A', 2)}"
    assert [(r["id"], r["original"]) for r in new2.collect()] == [(2, "zed@z.org")]


@pytest.mark.parametrize("staged", [None, stage])
def test_rows_without_scope_lose_nothing(spark, staged):
    rows = [("A", 1, "ping alice@x.com"), (None, 2, "hello alice@x.com and bob@y.com end"), (None, 3, "bye alice@x.com"), (None, 4, "quiet")]
    df = spark.createDataFrame(rows, "s string, turn int, text string")
    masked, new = mask_session(detect(df, RULES), SECRET, ["turn"], "s", ["turn"], stage=staged)
    got = {r["turn"]: r["masked"] for r in masked.collect()}
    assert got[2].startswith("hello ") and " and " in got[2] and got[2].endswith(" end") and got[4] == "quiet"
    assert not any("@" in t for t in got.values()) and masked.columns[:3] == df.columns
    # Each row without a scope has a vault of its own, and its key finds it.
    assert new.select("scope_key").distinct().count() == 3 and not new.where("scope_key is null").count()
    back = rehydrate(masked, new, SECRET, ["turn"], "s")
    assert {r["turn"]: r["rehydrated"] for r in back.collect()} == {r[1]: r[2] for r in rows}
    alone = mask_request(df, RULES, SECRET, "s").collect()
    assert all(r["masked"].startswith(r["text"].split()[0]) and "@" not in r["masked"] for r in alone)


def test_tenants_do_not_share(spark):
    df = spark.createDataFrame([("a", "S"), (None, "S"), (None, "t\u001fa\u001fS")], "t string, s string")
    got = [r[0] for r in df.select(namespace(F.col("s"), F.col("t"))).collect()]
    assert got == ["t\u001fa\u001fS", "g\u001fS", "g\u001ft\u001fa\u001fS"] and len(set(got)) == 3


def test_sharded_overflow(spark):
    df = spark.createDataFrame([("s", i, f"u{i}@x.org") for i in range(40)], "s string, turn int, text string")
    first = first_seen(detect(df, RULES), "s", ["turn"])
    rows = intern_sharded(first, shards=4, how="md5", shard_size=5).collect()
    stored = [r["id"] for r in rows if r["id"] != 2**32 - 1]
    assert len(rows) == 40 and len(stored) == len(set(stored)) and all(i & 0xFFFFF < 5 for i in stored)
    assert len(stored) < 40
    # Continuing leaves existing entries alone and never reuses an id.
    vault = intern_sharded(first.orderBy("original").limit(10), shards=4, how="md5")
    vault = stage(vault)
    more = intern_sharded(first, vault, shards=4, how="md5").collect()
    ids = [r["id"] for r in vault.collect()] + [r["id"] for r in more]
    assert len(ids) == len(set(ids)) == 40


@pytest.mark.parametrize("target", [3, 10_000])
def test_number_rows(spark, target):
    rng = random.Random(3)
    rows = [("hot", rng.randint(-50, 500), i) for i in range(300)] + [("c%d" % (i % 7), i, i) for i in range(20)]
    df = spark.createDataFrame(rows, "g string, o bigint, u bigint").repartition(5)
    base = spark.createDataFrame([("hot", 100), ("c1", 7)], "g string, start bigint")
    got = number_rows(df, ["g"], ["o", "u"], base, "p", target).collect()
    want = {}
    for g in {r[0] for r in rows}:
        for p, r in enumerate(sorted((r for r in rows if r[0] == g), key=lambda r: r[1:])):
            want[r] = p + {"hot": 100, "c1": 7}.get(g, 0)
    assert {(r["g"], r["o"], r["u"]): r["p"] for r in got} == want and len(got) == len(rows)


@pytest.mark.parametrize("uses", ["uses", None])
def test_lookup(spark, uses):
    left = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i}") for i in range(60)], "n int, k string")
    right = spark.createDataFrame([("hot", "H", 30)] + [(f"k{i}", f"v{i}", 1) for i in range(0, 40, 2)], "k string, v string, uses bigint")
    got = {r["n"]: r["v"] for r in lookup(left, right, ["k"], "v", uses, target=10).collect()}
    assert got == {i: "H" if i % 2 else (f"v{i}" if i < 40 else None) for i in range(60)}


def forged_texts():
    key = reader.scope_key(SECRET, "s")
    good = reader.sentinel("EMAIL", 0, reader.tag(key, 0))
    other = reader.sentinel(None, 1, reader.tag(key, 1))
    junk = "⟦S" + "x" * 70
    cases = [
        good, f"a {good} b {other} c", f"{good}{other}", "⟦S:EMAIL·0·1⟧ " + good, "before ⟦S:EMAIL·zz⟧ after",
        f"⟦S:EMAIL·zz⟧ then {good} tail", "⟦S" + good, f"⟦S junk {good}", f"⟦Sééééééééééééééééééééééééééé{good} end",
        f"{junk}{good}", f"{junk} and {good} " + "y" * 80, "⟦S·0·4gfFC4⟧ overflow " + "z" * 70 + good,
        reader.sentinel("X", 2**32 - 1, reader.tag(key, 2**32 - 1)), "open ⟦", "open ⟦S", f"{good} ⟦S", f"⟦S ⟧ {good}" + "q" * 90,
        "⟦S:" + "T" * 45 + "·0·" + reader.b62(reader.tag(key, 0)) + "⟧", "⟦S·00·" + reader.b62(reader.tag(key, 0)) + "⟧", "",
        "" + good + "", "⟦S·a·" + good + "·b⟧", "⟦" * 5 + good,
    ]
    rng = random.Random(5)
    parts = [good, other, "⟦S", "⟦", "⟧", "·", "é", "xy", "⟦S·9·9⟧", "z" * 30]
    return key, cases + ["".join(rng.choice(parts) for _ in range(rng.randint(1, 9))) for _ in range(150)]


def test_rehydrate_against_brute_force(spark):
    key, cases = forged_texts()
    vault = {0: "john@acme.com", 1: 'q"uote⟦S'}
    table = spark.createDataFrame([("s", i, o, "T", 0, 1) for i, o in vault.items()], VAULT)
    df = spark.createDataFrame([(i, "s", c) for i, c in enumerate(cases)], "id int, scope string, masked string")
    rows = rehydrate(df, table, SECRET, ["id"], "scope").collect()
    entries = F.array(*[F.struct(F.lit(i).cast("bigint").alias("id"), F.lit(o).alias("original")) for i, o in vault.items()])
    inline = {r[0]: r[1] for r in df.select("id", rehydrate_inline(F.col("masked"), entries, mac_pads(key))).collect()}
    assert len(rows) == len(cases)
    for r in rows:
        want = reader.rehydrate(r["masked"], vault, key)
        assert r["rehydrated"] == want == inline[r["id"]], r["masked"]
    joined = df.select("masked", F.array_join(F.transform(segments(F.col("masked")), lambda s: s["text"]), ""))
    assert all(a == b for a, b in joined.collect())


def test_tail_modes(spark):
    key = reader.scope_key(SECRET, "s")
    good = reader.sentinel(None, 0, reader.tag(key, 0))
    df = spark.createDataFrame([(f"⟦S bad⟧ {good}",)], "t string")
    count = lambda mode: len(df.select(parse_sentinels(F.col("t"), mode)).first()[0])
    assert (count("strict"), count("resolve")) == (0, 1)


def test_json_encoding(spark):
    key = reader.scope_key(SECRET, "s")
    vault = spark.createDataFrame([("s", 0, 'a"b\\c\nd', "T", 0, 1)], VAULT)
    body = '{"t":"' + reader.sentinel("T", 0, reader.tag(key, 0)) + '"}'
    df = spark.createDataFrame([(1, "s", body)], "id int, scope string, masked string")
    got = rehydrate(df, vault, SECRET, ["id"], "scope", encoding="json").first()["rehydrated"]
    assert got == '{"t":"a\\"b\\\\c\\nd"}'


def test_chunks_do_not_matter(spark):
    text = "a john@acme.com b Project Hufflepuff c jane@x.io"
    masked = mask_request(spark.createDataFrame([("k", text)], "k string, text string"), RULES, SECRET, "k").first()["masked"]
    rows = [(n, s, masked[i : i + n]) for n in (1, 2, 3, 5, 7, len(masked)) for s, i in enumerate(range(0, len(masked), n))]
    whole = join_chunks(spark.createDataFrame(rows, "n int, seq int, text string").repartition(3), ["n"])
    assert {r["text"] for r in whole.collect()} == {masked}


def test_audit_verdicts(spark):
    key = reader.scope_key(SECRET, "s")
    vault = spark.createDataFrame([("s", 0, "o", "T", 0, 1)], VAULT)
    good = reader.sentinel("T", 0, reader.tag(key, 0))
    text = f"{good} ⟦S:T·0·1⟧ ⟦S·5·5⟧ ⟦S·4gfFC3·1⟧ ⟦S·zz⟧"
    df = spark.createDataFrame([(1, "s", text)], "id int, scope string, masked string")
    got = sorted(r["verdict"] for r in audit_sentinels(df, vault, SECRET, ["id"], "scope").collect())
    assert got == ["forged", "malformed", "overflow", "resolved", "unknown"]


def test_merge_and_dedup(spark):
    old = spark.createDataFrame([("s", 0, "a", "T", 0, 1), ("s", 1, "b", "T", 0, 1)], VAULT)
    new = spark.createDataFrame([("s", 1, "b2", "T", 0, 1), ("s", 1 << 20, "a", "T", 0, 2)], VAULT)
    merged = merge_vault(old, new)
    assert {(r["id"], r["original"]) for r in merged.collect()} == {(0, "a"), (1, "b2"), (1 << 20, "a")}
    assert {(r["original"], r["id"]) for r in dedup_vault(merged).collect()} == {("a", 0), ("b2", 1)}


def test_seal(spark):
    df = spark.createDataFrame([("hello",), ("",)], "o string").select("o", seal(F.col("o"), "p").alias("s"))
    df = stage(df)
    rows = df.select("o", F.octet_length("s"), unseal(F.col("s"), "p"), unseal(F.col("s"), "q")).collect()
    assert [(r[1], r[2], r[3]) for r in rows if r["o"] == "hello"] == [(33, "hello", None)]


def test_vault_store(spark, tmp_path):
    path = str(tmp_path / "v")
    one = spark.createDataFrame([("s", 0, "a", "T", 0, 1), ("s", 2**32 - 1, "x", "T", 0, 1)], VAULT)
    commit_batch(one, path, 0, "pw")
    commit_batch(one, path, 0, "pw")
    commit_batch(spark.createDataFrame([("s", 0, "a2", "T", 0, 1), ("u", 0, "c", "T", 0, 1)], VAULT), path, 1, "pw")
    read = lambda **k: {(r["scope_key"], r["id"], r["original"]) for r in read_vault(spark, path, **k).collect()}
    assert read(passphrase="pw") == {("s", 0, "a2"), ("u", 0, "c")}
    assert read(passphrase="pw", before_batch=1) == {("s", 0, "a")}
    assert read(passphrase="pw", scopes=["u"]) == {("u", 0, "c")}
    assert read(passphrase="other") == set() and unsealable(spark, path, "other").count() == 2
    with pytest.raises(Exception):
        read_vault(spark, str(tmp_path / "gone")).count()


def test_sessionize(spark):
    rows = [("k", f"2024-01-01 00:{m:02d}:00") for m in (0, 5, 15, 24)]
    df = spark.createDataFrame(rows, "k string, ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    got = [r["generation"] for r in sessionize(df, ["k"], "ts", 600).orderBy("ts").collect()]
    assert got == [0, 0, 1, 1]


def test_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([("s", i, f"a{i % 5}@x.org b{i}@x.org") for i in range(30)], "s string, turn int, text string")
    ids = [
        sorted((r["id"], r["original"]) for r in intern_session(first_seen(detect(df.repartition(n), RULES), "s", ["turn"])).collect())
        for n in (1, 3, 8)
    ]
    assert ids[0] == ids[1] == ids[2]
