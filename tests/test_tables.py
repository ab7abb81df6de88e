import hashlib
import json
import time

import pytest
from pyspark.sql import functions as F

from palimpsest.operators import audit, policy
from palimpsest.operators.jsonpaths import extract_leaves, leaves, mask_json, typed_leaves, unmatched_paths
from palimpsest.operators.report import summary
from palimpsest.operators.ruleset import Rule, Ruleset
from palimpsest.sources.config import load_settings, parse_settings
from palimpsest.sources.exchanges import read_sse, split_oversized
from palimpsest.sources.logs import read_audit, read_transactions, write_audit, write_transactions
from palimpsest.sources.terms import as_terms, terms_from_dotenv, terms_from_kv_export, terms_from_lines
from tests import reader

SECRET = "5a" * 32
EMAIL = Ruleset((Rule("email", "EMAIL", r"[\w.]+@[\w.]+", 50),))
CHAT = '{"model":"gpt","messages":[{"role":"user","content":"ping me at a@b.com"},{"role":"x","content":"ok"}]}'


def bodies(spark, *values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id int, body string")


def masked(spark, body, paths, **kw):
    return mask_json(bodies(spark, body), EMAIL, SECRET, "id", paths=paths, **kw).first()


def test_mask_json_paths(spark):
    r = masked(spark, CHAT, ["messages[].content"])
    mark = reader.sentinel("EMAIL", 0, reader.tag(reader.scope_key(SECRET, "0"), 0))
    want = json.loads(CHAT)
    want["messages"][0]["content"] = f"ping me at {mark}"
    assert json.loads(r["masked_body"]) == want and r["report"]["total"] == 1
    nested = '{"messages":[{"tool_calls":[{"function":{"arguments":"to a@b.com"}}]}]}'
    r = masked(spark, nested, ["messages[].content", "messages[].tool_calls[].function.arguments"])
    assert json.loads(r["masked_body"])["messages"][0]["tool_calls"][0]["function"]["arguments"] == f"to {mark}"


def test_mask_json_everything(spark):
    body = '{"a":"x a@b.com","nested":{"b":"c@d.com"},"arr":["e@f.com"],"model":"gpt","n":1.5,"a.b":[{"k":"a@b.com"}]}'
    r = masked(spark, body, ["**"])
    assert r["report"]["total"] == 4 and len(r["entries"]) == 3 and "@" not in r["masked_body"]
    assert list(json.loads(r["masked_body"])) == sorted(json.loads(body))


def test_mask_json_dry_run(spark):
    r = masked(spark, CHAT, ["messages[].content"], enforce=False)
    assert r["masked_body"] == CHAT and r["report"]["summary"] == "EMAIL=1" and r["entries"] == []


def test_leaves_skip_other_kinds(spark):
    rows = bodies(spark, '{"m":[{"c":[1,"x"]},{"c":2},{"c":"t"},"s",null],"o":{"c":"y"},"q":"z"}', "{bad", None, '"s"', "[]")
    got = rows.select("id", leaves(F.col("body"), ["m[].c", "o[].c", "q.c", "o.c", "o.c"]).alias("l")).orderBy("id").collect()
    assert [(l["path"], l["text"]) for l in got[0]["l"]] == [("m[2].c", "t"), ("o.c", "y")]
    assert all(r["l"] == [] for r in got[1:])
    left = unmatched_paths(rows, ["id"], "body", ["m[].c", "q.c"]).where("id = 0").collect()
    assert [r["path"] for r in left] == ["q.c"]


def test_typed_leaves_agree(spark):
    df = bodies(spark, '{"a":[{"b":"x","c":null},{"b":"y","c":["p","q"]}],"z":"w"}')
    kind = "a array<struct<b:string,c:array<string>>>, z string"
    typed = df.withColumn("t", F.from_json("body", kind))
    got = typed.select(typed_leaves(F.col("t"), typed.schema["t"].dataType), leaves(F.col("body"), ["**"])).first()
    assert [tuple(x) for x in got[0]] == [tuple(x) for x in got[1]] and len(got[0]) == 5


def test_extract_leaves(spark):
    got = extract_leaves(bodies(spark, CHAT), ["id"], "body", ["messages[].content"]).collect()
    assert [(r["leaf_ord"], r["leaf_path"]) for r in got] == [(0, "messages[0].content"), (1, "messages[1].content")]


def test_fail_closed(spark):
    df = spark.createDataFrame([(1, '{"a":"x', "enforce"), (2, '{"a":"x', "dry-run"), (3, "{}", "enforce")], "id int, body string, mode string")
    sent, refused = policy.fail_closed_split(df)
    assert {r["id"] for r in sent.collect()} == {2, 3} and {r["id"] for r in refused.collect()} == {1}


def test_routes_and_hosts(spark):
    routes = spark.createDataFrame(
        [(0, "/a", None), (1, "/a/b", None), (2, "", "h.com"), (3, "/a", None), (4, "/", None), (5, None, "h.com")],
        "route_ord int, listen_path string, host string",
    )
    paths = ["/a", "/a/b/c", "/ab", "/a/", "", "/", "//x", "b/a"]
    df = spark.createDataFrame([(p, "h.com:443") for p in paths], "path string, host string")
    got = {r["path"]: (r["route_ord"], r["rest"]) for r in policy.match_route(df, routes).collect()}
    assert got == {"/a": (0, "/"), "/a/b/c": (0, "/b/c"), "/ab": (None, None), "/a/": (0, "/"), "": (None, None),
                   "/": (4, "/"), "//x": (4, "/x"), "b/a": (None, None)}
    assert {r["host_route_ord"] for r in policy.match_host(df, routes).collect()} == {2}


def test_headers(spark):
    df = spark.createDataFrame([({"Host": "h", "X-Key": "k", "Accept-Encoding": "gzip", "a": "1"},)], "h map<string,string>")
    got = df.select(policy.strip_request_headers(F.col("h"), "x-key"), policy.strip_response_headers(F.col("h"))).first()
    assert got[0] == {"a": "1", "accept-encoding": "identity"} and "Host" in got[1]


def records(spark, n=3):
    rows = [("c", i, f"/r{i}", None if i % 2 else "té\"n", "enforce", i, {"SECRET": 1, "EMAIL": i}) for i in range(n)]
    return spark.createDataFrame(rows, "chain string, ts bigint, route string, tenant string, mode string, detected bigint, types map<string,bigint>")


def chain(spark, n=3, **kw):
    return audit.chain_append(records(spark, n), ["chain"], ["ts"], **kw)


def test_chain_is_the_documented_hash(spark):
    prev = ""
    for r in chain(spark).orderBy("seq").collect():
        doc = {k: r[k] for k in ("seq", "ts", "route", "tenant", "mode", "detected")}
        doc |= {"types": dict(sorted(r["types"].items())), "prev": prev, "hash": ""}
        text = json.dumps(doc, separators=(",", ":"), ensure_ascii=False)
        assert r["prev"] == prev and r["hash"] == hashlib.sha256((prev + text).encode()).hexdigest()
        prev = r["hash"]


def verdict(df, **kw):
    r = audit.chain_verify(df, ["chain", "segment"], **kw).first()
    return r["count"], r["broken_at"], r["last_hash"]


def test_verify(spark):
    df = chain(spark).cache()
    hashes = [r["hash"] for r in df.orderBy("seq").collect()]
    assert verdict(df) == (3, None, hashes[2])
    edited = df.withColumn("detected", F.when(F.col("seq") == 0, 9).otherwise(F.col("detected")))
    assert verdict(edited) == (0, 0, "")
    assert verdict(df.where("seq <> 1")) == (1, 2, hashes[0])
    assert verdict(df.where("seq > 0")) == (0, 1, "")
    assert verdict(df.where("seq < 2")) == (2, None, hashes[1])
    swapped = df.withColumn("pos", F.when(F.col("seq") == 0, 1).when(F.col("seq") == 1, 0).otherwise(F.col("seq")))
    assert verdict(swapped, position="pos")[:2] == (0, 1)
    bad = audit.tamper_localise(edited, ["chain", "segment"]).collect()
    assert [(r["at"], r["problem"]) for r in bad] == [(0, "record altered")]


def test_segments_and_continuation(spark):
    df = chain(spark, 7, segment_rows=3)
    got = audit.chain_verify(df, ["chain", "segment"]).collect()
    assert {(r["segment"], r["count"], r["broken_at"]) for r in got} == {(0, 3, None), (1, 3, None), (2, 1, None)}
    head = df.where("segment = 2").first()["hash"]
    start = spark.createDataFrame([("c", 2, 1, head)], "chain string, segment bigint, seq bigint, prev string")
    more = audit.chain_append(records(spark, 4), ["chain"], ["ts"], start, segment_rows=3)
    both = df.unionByName(more)
    got = audit.chain_verify(both, ["chain", "segment"]).collect()
    assert {(r["segment"], r["count"], r["broken_at"]) for r in got} == {(0, 3, None), (1, 3, None), (2, 3, None), (3, 2, None)}
    hot = chain(spark, 7, segment_rows=3, target=2)
    assert {tuple(r) for r in hot.select("seq", "hash").collect()} == {tuple(r) for r in df.select("seq", "hash").collect()}


def test_long_segments_and_histories_cost_their_length(spark):
    """The hashes of 30,000 records of one segment took minutes when each record copied those before it."""
    began = time.monotonic()
    log = chain(spark, 30_000, segment_rows=30_000).cache()
    rows = log.select("seq", "prev", "hash").orderBy("seq").collect()
    assert time.monotonic() - began < 45
    assert [r["seq"] for r in rows] == list(range(30_000)) and rows[0]["prev"] == ""
    assert all(b["prev"] == a["hash"] for a, b in zip(rows, rows[1:]))
    assert verdict(log) == (30_000, None, rows[-1]["hash"])
    # Blocks of a running value meet at multiples of their length.
    short = chain(spark, 600, segment_rows=2).cache()
    before = ""
    for r in audit.chain_seals(short, ["chain"]).orderBy("segment").collect():
        text = "|".join(map(str, (before, r["segment"], r["count"], r["last_hash"])))
        assert r["prev_seal"] == before and r["seal"] == hashlib.sha256(text.encode()).hexdigest()
        before = r["seal"]
    assert r["segment"] == 299


def history(log, seals, **kw):
    r = audit.verify_history(log, seals, ["chain"], **kw).first()
    return r["count"], r["broken_segment"], r["problem"]


def test_history_shows_every_cut(spark):
    log = chain(spark, 30, segment_rows=10).cache()
    seals = audit.chain_seals(log, ["chain"]).cache()
    at = F.col("segment") * 10 + F.col("seq")
    assert history(log, seals) == (30, None, None)
    assert history(log.where(~at.between(5, 9)), seals) == (5, 0, "tail missing")
    assert history(log.where(~at.between(15, 19)), seals) == (15, 1, "tail missing")
    assert history(log.where("segment <> 1"), seals) == (10, 1, "segment missing")
    assert history(log.where("segment <> 1"), seals.where("segment <> 1")) == (10, 2, "seal before missing or altered")
    assert history(log, seals.where("segment <> 1"))[:2] == (10, 1)
    assert history(log.where(at != 12), seals) == (12, 1, "record altered or missing")
    fewer = seals.withColumn("count", F.when(F.col("segment") == 1, 5).otherwise(F.col("count")))
    assert history(log.where(~at.between(15, 19)), fewer) == (10, 1, "seal altered")
    heads = seals.where("segment = 2")
    assert history(log, seals, heads=heads) == (30, None, None)
    cut = history(log.where("segment < 2"), seals.where("segment < 2"), heads=heads)
    assert cut == (20, 2, "last segments missing")
    # Seals that continue are those of the whole.
    late = audit.chain_seals(log.where("segment > 0"), ["chain"], seals.where("segment = 0"))
    assert {r["seal"] for r in late.collect()} == {r["seal"] for r in seals.where("segment > 0").collect()}


def test_audit_files(spark, tmp_path):
    path = str(tmp_path / "audit")
    write_audit(chain(spark), path, ["chain", "segment"])
    log = read_audit(spark, path)
    r = audit.chain_verify(log, ["file"], "position").first()
    assert (r["count"], r["broken_at"]) == (3, None)
    file = next((tmp_path / "audit").rglob("part-*.txt"))
    lines = file.read_text().splitlines()
    other = tmp_path / "one.jsonl"
    other.write_text("\n".join([lines[0], "", lines[1], "not json", lines[2]]) + "\n")
    r = audit.chain_verify(read_audit(spark, str(other)), ["file"], "position").first()
    assert (r["count"], r["broken_at"]) == (2, 3)


def test_transactions(spark, tmp_path):
    df = spark.createDataFrame([(1, "r", "GET", "123456789ABCDEF")], "ts bigint, route string, method string, response string").select(
        "*", F.lit(None).cast("string").alias("tenant"), F.lit("/p").alias("path"), F.lit(200).alias("status"),
        F.lit("enforce").alias("mode"), F.lit("q").alias("request"),
        F.struct(F.create_map(F.lit("E"), F.lit(1).cast("bigint")).alias("by_type"), F.lit(1).cast("bigint").alias("total")).alias("report"),
    )
    tx = audit.transactions(df, ["ts"], 8)
    write_transactions(tx, str(tmp_path / "tx"))
    r = read_transactions(spark, str(tmp_path / "tx")).first()
    assert (r["response"], r["response_truncated"], r["request_truncated"], len(r["id"])) == ("12345678", True, False, 16)


@pytest.mark.parametrize("limit", [None, 0])
def test_secret_free(spark, limit):
    vault = spark.createDataFrame([("s", 0, "top"), ("t", 0, "other")], "scope_key string, id bigint, original string")
    tx = spark.createDataFrame([(1, "s", "a stop b"), (2, "s", "other"), (3, "t", "clean")], "id int, scope string, body string")
    assert [r["id"] for r in audit.secret_free_check(tx, vault, ["id"], "body", "scope", limit).collect()] == [1]


def test_summary(spark):
    df = spark.createDataFrame([({"SECRET": 1, "EMAIL": 2},), ({},)], "m map<string,bigint>")
    assert [r[0] for r in df.select(summary(F.col("m"))).collect()] == ["EMAIL=2,SECRET=1", ""]


def lines(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "value string")


def test_term_sources(spark):
    env = lines(spark, "SECRET_TOKEN=supersecret-abc123", "# X=commented-out", "export Q='qu oted'", "S=1234", "noise", "E=", 'D="a=b#c"')
    assert {r["term"] for r in terms_from_dotenv(env).collect()} == {"supersecret-abc123", "qu oted", "a=b#c"}
    assert {r["term"] for r in terms_from_lines(lines(spark, " value-one ", "", "# no", "abcd")).collect()} == {"value-one"}
    kv = '{"data":{"data":{"api_key":"sk-supersecret-vault-value","db_password":"vaultpass123","port":"8200","n":123456}}}'
    found = terms_from_kv_export(lines(spark, kv, "{bad"))
    assert {r["term"] for r in found.collect()} == {"sk-supersecret-vault-value", "vaultpass123"}
    assert {(t.ty, t.priority) for t in as_terms(found)} == {("SECRET", 80)}


def test_sse(spark):
    body = 'data: {"a":1}\n\n: comment\n\nevent: x\ndata:{"b":2}\n\ndata: [DONE]\n\ndata: {bad\n\n'
    got = read_sse(bodies(spark, body), ["id"]).orderBy("event", "line").collect()
    assert [r["payload"] for r in got] == ['{"a":1}', None, None, '{"b":2}', None, None]


def test_size_cap(spark):
    fits, refused = split_oversized(bodies(spark, "aé", "aéé", None), limit=3)
    assert {r["id"] for r in fits.collect()} == {0, 2} and {r["id"] for r in refused.collect()} == {1}


SETTINGS = r"""
routes:
  - { listen_path: "/chat", upstream: "https://svc.example.com/", profile: chat, mode: dry-run }
profiles:
  chat: { scan_paths: ["messages[].content"] }
masking: { scope: session, ttl: 30m }
glossary:
  - { term: "Project Hufflepuff", type: CODENAME, priority: 100 }
rules:
  - { name: aws_key, type: SECRET, pattern: 'AKIA[0-9A-Z]{16}', priority: 90 }
entropy: { enabled: true, min_bits: 4.0 }
tenants:
  - { id: acme, keys: [k1], glossary: [{ term: FALCON, type: CODENAME }] }
sources:
  - { kind: dotenv, path: /x/.env }
unknown: 1
"""


def test_settings(spark, tmp_path):
    file = tmp_path / "s.yaml"
    file.write_text(SETTINGS)
    s = load_settings(spark, str(file))
    assert s.ruleset.entropy.enabled and s.ruleset.entropy.min_len == 20 and s.ruleset.entropy.min_bits == 4.0
    assert [t.tenant for t in s.ruleset.terms] == [None, "acme"]
    assert s.defaults == {"mode": "enforce", "scope": "session", "style": "typed-sentinel"}
    assert s.sources[0]["min_len"] == 5 and s.routes[0]["upstream"] == "https://svc.example.com"
    assert s.routes_df(spark).first()["mode"] == "dry-run" and s.tenants_df(spark).first()["keys"] == ["k1"]
    assert s.profiles_df(spark).first()["scan_paths"] == ["messages[].content"]
    assert s.terms_df(spark).count() == 2 and s.rules_df(spark).count() == 1
    assert parse_settings("{}").ruleset == Ruleset()
    with pytest.raises(ValueError):
        parse_settings("masking: { mode: off-ish }")
