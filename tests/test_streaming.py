import json
import random

import pytest
from pyspark.sql import functions as F

from palimpsest.functions.sentinel import mac_pads
from palimpsest.operators.mask import apply_spans, mask_request
from palimpsest.operators.rehydrate import rehydrate
from palimpsest.operators.ruleset import Rule, Ruleset
from palimpsest.plans import catalog
from palimpsest.sources.vault_store import read_vault
from palimpsest.streaming.mask_stream import (
    RuleRefresher,
    VaultMasker,
    detection_metrics,
    mask_session_stream,
    stream_texts,
)
from palimpsest.streaming.rehydrate_stream import StreamResolver, ready_length, reframe, rehydrate_sse
from tests import reader

SECRET = "5a" * 32
RULES = Ruleset((Rule("email", "EMAIL", r"[\w.]+@[\w.]+", 50),))
TURNS = "row_id string, s string, turn bigint, text string"
ROWS = [
    ("a1", "A", 1, "ping alice@x.com"),
    ("a2", "A", 2, "new bob@y.com old alice@x.com"),
    ("b1", "B", 1, "only alice@x.com"),
    ("a3", "A", 3, "bob@y.com zed@z.org"),
    ("b2", "B", 2, "quiet"),
]
IDS = {("A", "alice@x.com"): 0, ("A", "bob@y.com"): 1, ("A", "zed@z.org"): 2, ("B", "alice@x.com"): 0}


def wanted():
    out = {}
    for row, s, _, text in ROWS:
        for (scope, original), n in IDS.items():
            if scope == s:
                text = text.replace(original, reader.sentinel("EMAIL", n, reader.tag(reader.scope_key(SECRET, s), n)))
        out[row] = text
    return out


def folder(spark, tmp_path, schema, *batches):
    """A stream that sees one batch after the other."""
    path = tmp_path / "in"
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(path / f"b={i}"))
    return stream_texts(spark, str(path / "*"), schema, files_per_trigger=1)


def drain(df, tmp_path, body=None, name="q", mode="append"):
    out = str(tmp_path / name)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch_id={batch_id}")

    q = (
        df.writeStream.outputMode(mode)
        .option("checkpointLocation", str(tmp_path / f"{name}-state"))
        .trigger(availableNow=True)
        .foreachBatch(body or write)
        .start()
    )
    assert q.awaitTermination(120)
    return df.sparkSession.read.parquet(out) if body is None else None


def test_session_stream_equals_batch(spark, tmp_path):
    texts = folder(spark, tmp_path, TURNS, ROWS[:3], ROWS[3:])
    out = drain(mask_session_stream(texts, RULES, SECRET, "row_id", "s", "turn", ttl_seconds=None), tmp_path)
    assert {r["row_id"]: r["masked"] for r in out.collect()} == wanted()


def test_request_stream_is_the_batch_plan(spark, tmp_path):
    texts = folder(spark, tmp_path, TURNS, ROWS)
    out = drain(mask_request(texts, RULES, SECRET, "row_id").select("row_id", "masked"), tmp_path)
    batch = mask_request(spark.createDataFrame(ROWS, TURNS), RULES, SECRET, "row_id")
    assert {tuple(r) for r in out.select("row_id", "masked").collect()} == {(r["row_id"], r["masked"]) for r in batch.collect()}


@pytest.mark.parametrize("passphrase", [None, "pw"])
def test_vault_masker_commits_and_replays(spark, tmp_path, passphrase):
    vault, out = str(tmp_path / "vault"), str(tmp_path / "out")
    masker = VaultMasker(RULES, SECRET, vault, out, ["row_id"], "s", ["turn"], passphrase=passphrase)
    first, second = spark.createDataFrame(ROWS[:3], TURNS), spark.createDataFrame(ROWS[3:], TURNS)
    for batch, n in ((first, 0), (first, 0), (second, 1), (second, 1)):
        masker(batch, n)
    rows = spark.read.option("basePath", out).parquet(out).collect()
    assert {r["row_id"]: r["masked"] for r in rows} == wanted() and len(rows) == len(ROWS)
    stored = read_vault(spark, vault, passphrase).collect()
    assert {(r["scope_key"], r["original"]): r["id"] for r in stored} == IDS
    back = rehydrate(spark.read.parquet(out), read_vault(spark, vault, passphrase), SECRET, ["row_id"], "s")
    assert {r["row_id"]: r["rehydrated"] for r in back.collect()} == {r[0]: r[3] for r in ROWS}


def test_rules_keep_the_last_good(spark, tmp_path):
    file = tmp_path / "rules.yaml"
    with pytest.raises(Exception):
        RuleRefresher(spark, str(file))
    file.write_text("rules: [{ name: a, type: A, pattern: 'aa+' }]")
    live = RuleRefresher(spark, str(file))
    file.write_text("rules: [{ name: a, type: A, pattern: '(' }]")
    assert live.current().ruleset.rules[0].pattern == "aa+" and live.last_error is not None
    file.write_text("rules: [{ name: b, type: B, pattern: 'bb+' }]")
    assert live.current().ruleset.rules[0].pattern == "bb+" and live.last_error is None


def test_ready_length_is_lossless():
    key = reader.scope_key(SECRET, "s")
    good = reader.sentinel("EMAIL", 0, reader.tag(key, 0))
    vault = {0: "john@acme.com"}
    rng = random.Random(2)
    for _ in range(300):
        text = "".join(rng.choice([good, "⟦S", "⟦", "⟧", "é", "ab", "⟦S·zz⟧", "x" * 40]) for _ in range(rng.randint(1, 8)))
        carry, out = "", ""
        i = 0
        while i < len(text):
            n = rng.randint(1, 9)
            carry += text[i : i + n]
            i += n
            ready = ready_length(carry)
            # Emitted pieces never cut a placeholder, so each resolves alone.
            out += resolve_whole(carry[:ready], vault, key)
            carry = carry[ready:]
            assert len(carry.encode()) < 64
        assert out + carry == reader.rehydrate(text, vault, key)


def resolve_whole(piece, vault, key):
    # Padding keeps the reader from holding the end back.
    pad = "." * 80
    return reader.rehydrate(piece + pad, vault, key)[: -len(pad)]


def test_rehydrate_stream(spark, tmp_path):
    key = reader.scope_key(SECRET, "s")
    good = reader.sentinel("EMAIL", 0, reader.tag(key, 0))
    texts = {"r1": f"to {good}, ⟦S:EMAIL·0·1⟧ end", "r2": f"{good}{good}", "r3": "open ⟦S:EM"}
    rows = []
    for rid, t in texts.items():
        cuts = [t[i : i + 5] for i in range(0, len(t), 5)]
        rows += [(rid, "c", i, c, i == len(cuts) - 1) for i, c in enumerate(cuts)]
    schema = "response_id string, leaf_path string, seq bigint, text string, eos boolean"
    early = [r for r in rows if r[2] < 3]
    late = [r for r in rows if r[2] >= 3] + [("r1", "c", 1, "again", False)]
    chunks = folder(spark, tmp_path, schema, early, late)
    vault = spark.createDataFrame([("s", 0, "john@acme.com", "T", 0, 1)],
                                  "scope_key string, id bigint, original string, ty string, first_seen bigint, uses bigint")
    scopes = spark.createDataFrame([(r, "s") for r in texts], "response_id string, scope_key string")
    out, dropped = str(tmp_path / "done"), str(tmp_path / "late")
    drain(reframe(chunks, idle_seconds=None), tmp_path, StreamResolver(lambda: vault, scopes, SECRET, out, dropped))
    got = {}
    for r in sorted(spark.read.parquet(out).collect(), key=lambda r: (r["seq"], r["verbatim"])):
        got[r["response_id"]] = got.get(r["response_id"], "") + r["rehydrated"]
    assert got == {r: reader.rehydrate(t, {0: "john@acme.com"}, key) for r, t in texts.items()}
    assert [r["text"] for r in spark.read.parquet(dropped).collect()] == ["again"]


def test_sse_leaves_do_not_mix(spark):
    key = reader.scope_key(SECRET, "s")
    good = reader.sentinel("EMAIL", 0, reader.tag(key, 0))
    events = []
    for i, part in enumerate([good[:4], good[4:9], good[9:]]):
        events.append({"choices": [{"delta": {"content": part}}, {"delta": {"content": "XYZ"[i]}}]})
    body = "".join(f"data: {json.dumps(e, ensure_ascii=False)}\n\n" for e in events) + "data: [DONE]\n\n"
    vault = spark.createDataFrame([("s", 0, 'j"ohn', "T", 0, 1)],
                                  "scope_key string, id bigint, original string, ty string, first_seen bigint, uses bigint")
    df = spark.createDataFrame([("r", "s", body)], "rid string, scope string, body string")
    got = rehydrate_sse(df, vault, SECRET, "rid", "scope", ["choices[].delta.content"]).collect()
    assert {r["leaf_path"]: r["rehydrated"] for r in got} == {
        "choices[0].delta.content": 'j"ohn', "choices[1].delta.content": "XYZ",
    }


def test_metrics(spark, tmp_path):
    rows = [("2024-01-01 00:10:00", "a@b.com"), ("2024-01-01 00:50:00", "c@d.com e@f.com"), ("2024-01-01 01:10:00", "g@h.com")]
    schema = "at string, text string"
    texts = folder(spark, tmp_path, schema, rows).withColumn("ts", F.col("at").cast("timestamp"))
    out = drain(detection_metrics(texts, RULES), tmp_path, mode="complete")
    assert sorted(r["detected"] for r in out.collect()) == [1, 3]


def test_streams_read_a_folder_of_files(spark, tmp_path):
    """A larger table is a folder; its files are not named like the table."""
    docs = [(i, f"mail u{i}@x.com") for i in range(8)]
    spark.createDataFrame(docs, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/folder/documents.parquet")
    turns = [(c, t, "the scheinque") for c in range(3) for t in range(2)]
    turns = spark.createDataFrame(turns, "conv_id long, turn long, text string")
    turns.repartition(2).write.parquet(f"{tmp_path}/folder/conversations.parquet")
    times = spark.sql("select id as user_id, timestamp_seconds(id * 1800) as ts from range(4)")
    times.repartition(2).write.parquet(f"{tmp_path}/folder/events.parquet")
    (tmp_path / "file").mkdir()
    for name in ("documents", "conversations", "events"):
        spark.read.parquet(f"{tmp_path}/folder/{name}.parquet").coalesce(1).write.parquet(f"{tmp_path}/one-{name}")
        (part,) = (tmp_path / f"one-{name}").glob("part-*.parquet")
        part.rename(tmp_path / "file" / f"{name}.parquet")
    for query, n in ((catalog.stream_mask, 8), (catalog.stream_mask_session, 6), (catalog.stream_metrics, 4)):
        whole, single = (sorted(map(tuple, query(spark, f"{tmp_path}/{d}").collect())) for d in ("folder", "file"))
        assert whole == single and len(whole) == n


def test_rows_of_one_row_group_are_dealt(spark, tmp_path, monkeypatch):
    """A file of one row group was read, parsed, searched and masked by one task."""

    class Enough(Exception):
        pass

    def dealt(rows):
        # Few rows are one partition all the same, so the plan is asked.
        return "REBALANCE_PARTITIONS_BY_NONE" in rows._jdf.queryExecution().executedPlan().toString()

    said = F.concat(F.sha2(F.col("id").cast("string"), 256), F.sha2(F.concat("id", F.lit("x")), 256))
    rows = spark.range(60).coalesce(1)
    events = rows.select(
        F.col("id").alias("event_id"), F.lit("view").alias("event_type"), F.rand(1).alias("value"),
        F.col("id").alias("user_id"), said.alias("props"),
    )
    events.write.parquet(f"{tmp_path}/events.parquet")
    turns = rows.select(F.col("id").alias("conv_id"), F.lit(0).cast("long").alias("turn"), said.alias("text"))
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    assert dealt(catalog._event_bodies(spark, str(tmp_path)))

    def detect(given, _):
        assert dealt(given)
        raise Enough

    monkeypatch.setattr(catalog, "detect", detect)
    with pytest.raises(Enough):
        catalog._session(spark, str(tmp_path))


def test_marks_of_an_original_are_made_once(spark):
    """An original that stands often in a text, under two types, and one beyond the vault."""
    text = "aa bb aa cc aa"
    spans = [(i, i + 2, "X" if i < 9 else "Y", text[i : i + 2]) for i in (0, 3, 6, 9, 12)]
    rows = spark.createDataFrame([(text, {"aa": 7, "bb": 1}, spans)], "text string, ids map<string,bigint>, "
        "spans array<struct<byte_start:int,byte_end:int,ty:string,original:string>>")  # fmt: skip
    pads = mac_pads(SECRET)
    of = lambda s: F.coalesce(F.element_at("ids", s["original"]), F.lit(99).cast("long"))
    got = rows.select(
        apply_spans(F.col("text"), F.col("spans"), of, pads), apply_spans(F.col("text"), F.col("spans"), of, pads, known=F.col("ids"))
    ).first()
    assert got[0] == got[1] and got[0].count(reader.sentinel("X", 7, reader.tag(SECRET, 7))) == 2
